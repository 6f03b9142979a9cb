"""Rating-event sources and sinks.

Canonical schema: ``user_id BIGINT, item_id BIGINT, rating DOUBLE, ts BIGINT,
event_id BIGINT`` (+ ``price DOUBLE`` for priced logs).  ``event_id`` is the
replay order of the input and breaks timestamp ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqrec.functions.exprs import epoch_micros, epoch_seconds
from seqrec.operators.ordering import global_ordinal

RATINGS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("ts", T.LongType()),
    T.StructField("event_id", T.LongType()),
])

# Field separators of the supported text dialects.
SEPARATORS = {
    "tsv": "\t",            # ml-100k, ciao, epinion
    "double_colon": "::",   # ml-1m, ml-10m, MovieTweetings
    "csv": ",",             # ml-20m
    "priced_tsv": "\t",     # user, item, rating, price, ts
}

_TEXT_COLS = ["user_id", "item_id", "rating", "ts"]
_PRICED_COLS = ["user_id", "item_id", "rating", "price", "ts"]


def _parsed(spark: SparkSession, path: str, fmt: str, header: bool) -> DataFrame:
    """Every line with its typed fields, its place in the input and ``ok``: whether all fields could be read."""
    if fmt not in SEPARATORS:
        raise ValueError(f"unknown ratings format {fmt!r}")
    names = _PRICED_COLS if fmt == "priced_tsv" else _TEXT_COLS
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (spark.read.schema(schema).option("sep", SEPARATORS[fmt])
           .option("header", str(header).lower()).option("mode", "PERMISSIVE").csv(path))
    typed = raw.select(
        F.expr("try_cast(trim(user_id) as bigint)").alias("user_id"),
        F.expr("try_cast(trim(item_id) as bigint)").alias("item_id"),
        F.expr("try_cast(trim(rating) as double)").alias("rating"),
        *([F.expr("try_cast(trim(price) as double)").alias("price")] if fmt == "priced_tsv" else []),
        F.expr("try_cast(trim(ts) as bigint)").alias("ts"),
        F.concat_ws(SEPARATORS[fmt], *[F.coalesce(n, F.lit("")) for n in names]).alias("line"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"))
    return typed.withColumn("ok", F.expr("user_id is not null and item_id is not null and rating is not null and ts is not null"))


def read_ratings(spark: SparkSession, path: str, fmt: str = "tsv", header: bool = False,
                 keep_price: bool = False) -> DataFrame:
    """Read a delimited rating log into the canonical schema.

    Every field is read as a string and cast with ``try_cast``; lines that do
    not parse (a header, junk) are left to ``rejected_lines``.  ``event_id`` is
    the dense place of a line among those kept, files in order of their paths.
    """
    rows = _parsed(spark, path, fmt, header).where("ok").drop("line", "ok")
    out = global_ordinal(rows, ["_file", "_block", "_place"], out="event_id")
    cols = ["user_id", "item_id", "rating", "ts", "event_id"]
    if fmt == "priced_tsv" and keep_price:
        cols.insert(3, "price")
    return out.select(*cols)


def rejected_lines(spark: SparkSession, path: str, fmt: str = "tsv", header: bool = False) -> DataFrame:
    """The lines that ``read_ratings`` leaves out: ``(file, line)``."""
    return _parsed(spark, path, fmt, header).where("not ok").select(F.col("_file").alias("file"), "line")


def write_ratings(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Write the four text columns (plus price for ``priced_tsv``) as one dialect.

    Multi-character separators are not supported by the CSV writer, so lines
    are assembled and written as text; a null field stays in place, empty.
    """
    names = _PRICED_COLS if fmt == "priced_tsv" else _TEXT_COLS
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    (df.select(F.concat_ws(SEPARATORS[fmt], *parts).alias("value"))
       .write.mode("overwrite").text(path))


def events_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings view E over the driver's ``events`` table (ts in epoch micros)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("value") / 20))).cast("double").alias("rating"),
        epoch_micros("ts").alias("ts"),
        F.col("event_id").cast("bigint").alias("event_id"),
    )


def lineitem_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings view L: customers buy parts (``orders`` joined to ``lineitem``).

    ``ts`` is epoch seconds of the order date; many ties, broken by a dense
    ``event_id`` over (date, orderkey, linenumber, partkey, suppkey).
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ts = epoch_seconds("o_orderdate")
    base = j.select(
        F.col("o_custkey").cast("bigint").alias("user_id"),
        F.col("l_partkey").cast("bigint").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        ts.alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    ordered = global_ordinal(base, ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                             out="event_id")
    return ordered.select("user_id", "item_id", "rating", "ts", "event_id")
