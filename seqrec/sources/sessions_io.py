"""Session text files: ``user<TAB>i1,i2,...,`` -- one line per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.operators.sessions import session_corpus


def session_lines(sessions: DataFrame) -> DataFrame:
    """One text line per session (``value`` column), trailing comma included."""
    corpus = session_corpus(sessions)
    return corpus.select(F.concat(F.col("user_id").cast("string"), F.lit("\t"),
                                  F.array_join("tokens", ","), F.lit(",")).alias("value"))


def write_sessions(sessions: DataFrame, path: str) -> None:
    session_lines(sessions).write.mode("overwrite").text(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Parse session lines: lines with fewer than two tab fields are skipped,
    the item field is right-stripped, split on commas and its last (empty)
    token dropped.  Returns ``(user_id STRING, tokens ARRAY<STRING>)``."""
    raw = spark.read.text(path)
    parts = F.split(F.col("value"), "\t")
    fields = raw.select(parts.alias("p")).where(F.size("p") >= 2)
    toks = F.split(F.rtrim(F.col("p")[1]), ",")
    return fields.select(F.col("p")[0].alias("user_id"),
                         F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))).alias("tokens"))
