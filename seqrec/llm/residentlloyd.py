"""Vector codes by product quantisation in integers, trained with members that stay where they are.

Vectors are scaled to integers and cut into equal parts.  A part lives with its owner, the key (position, entry, salt): owners
are the buckets of a bucketed table.  In each round the owners sum their resident members, the sums give the next
codebooks, and the owners compare their members with them.  Only parts whose entry changes are written and
shuffled to their new owner; the others meet them there without an exchange, since the table is read by its
buckets.  The salt splits an entry over as many owners as its members need and grows with them, so
no owner holds more than about `member_rows` parts, whatever share of the rows one entry attracts.

All numbers are integers and all sums are exact, so the result does not depend on the partitioning.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm.ship import ship
from seqrec.llm.vectors import doubles, finite, lists, matrix, of_commonest_length
from seqrec.session import cut, scratch_path

OWNER = ["pos", "entry", "salt"]
_EXACT = pa.decimal128(38, 0)


def _number(most: int, dims: int):
    """The cheapest numpy type that holds squared distances of parts with components up to `most` exactly."""
    largest = 8 * max(1, dims) * max(1, most) ** 2
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def _assign(x: np.ndarray, book: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (the lowest on ties) and its squared distance."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for at in range(0, len(x), block):
        d = _squares(x[at:at + block], book)
        near[at:at + block] = k = d.argmin(1)
        far[at:at + block] = d[np.arange(len(k)), k]
    return near, far


class _Resident:
    """Parts in a bucketed table of the shared folder; reading it by its owners needs no exchange."""

    def __init__(self, parts: DataFrame, buckets: int):
        self.spark, self.name = parts.sparkSession, f"resident_{uuid.uuid4().hex}"
        (parts.write.format("parquet").bucketBy(buckets, *OWNER).option("path", scratch_path(self.spark, "resident")).saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Takes the table out of the catalogue; its files stay in the scratch folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _salted(parts: DataFrame, salts: DataFrame) -> DataFrame:
    """The salt of each part's owner; `salts` has one row for each entry of each codebook."""
    return (parts.join(F.broadcast(salts), ["pos", "entry"])
            .withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).select(*OWNER, "rid", "x"))


def _need(counts: dict, member_rows: int, before: dict | None = None) -> dict:
    """Owners of each entry: a power of two that grows with its members and never falls."""
    return {k: max((before or {}).get(k, 1), 1 << max(0, (-(-n // member_rows) - 1).bit_length())) for k, n in counts.items()}


def _sums(residents: DataFrame, kind) -> tuple[dict, dict]:
    """Number and exact component sums of the members of every entry, summed by their owners first."""
    schema = "pos int, entry int, j int, n bigint, s decimal(38,0)"

    def run(batches):
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, entry = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix(batch.column(2), np.int64 if kind is not object else object)
            keys, at = np.unique(pos.astype(np.int64) << 32 | entry, return_inverse=True)
            n = np.bincount(at, minlength=len(keys))
            s = np.zeros((len(keys), x.shape[1]), x.dtype)
            np.add.at(s, at, x)
            for k, key in enumerate(keys.tolist()):
                held = total.get(key)
                total[key] = (int(n[k]), [int(v) for v in s[k]]) if held is None else (held[0] + int(n[k]), [a + int(b) for a, b in zip(held[1], s[k])])
        for key, (n, s) in total.items():
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([key >> 32] * d, pa.int32()), pa.array([key & 0xFFFFFFFF] * d, pa.int32()), pa.array(range(d), pa.int32()),
                                              pa.array([n] * d, pa.int64()), pa.array([Decimal(v) for v in s], _EXACT)], names=["pos", "entry", "j", "n", "s"])

    rows = (residents.select("pos", "entry", "x").mapInArrow(run, schema).groupBy("pos", "entry", "j")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    counts, sums = {}, {}
    for r in rows:
        counts[r["pos"], r["entry"]] = r["n"]
        sums.setdefault((r["pos"], r["entry"]), {})[r["j"]] = int(r["s"])
    return counts, sums


def _moves(residents: DataFrame, books: list[np.ndarray], kind, ints: str) -> DataFrame:
    """What leaves an owner (x null) and what comes to another (salt null) under new codebooks."""
    inner = pa.int32() if ints == "int" else pa.int64()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, entry = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix(batch.column(4), kind)
            near = np.zeros(len(x), np.int64)
            for p in np.unique(pos):
                near[pos == p] = _assign(x[pos == p], books[p])[0]
            at = np.flatnonzero(near != entry)
            if len(at):
                left, k = batch.take(pa.array(at)), len(at)
                yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), left.column(2), left.column(3), pa.nulls(k, pa.list_(inner))], names=[*OWNER, "rid", "x"])
                yield pa.RecordBatch.from_arrays([left.column(0), pa.array(near[at].astype(np.int32)), pa.nulls(k, pa.int32()), left.column(3), left.column(4)], names=[*OWNER, "rid", "x"])

    return residents.select(*OWNER, "rid", "x").mapInArrow(run, f"pos int, entry int, salt int, rid bigint, x array<{ints}>")


def _settled(key, residents: pa.Table, notes: pa.Table) -> pa.Table:
    """An owner's members after one migration."""
    come = notes.filter(notes["x"].is_valid())
    if not residents.num_rows:
        return come
    gone = notes.filter(notes["x"].is_null())["rid"].to_numpy()
    stay = residents.filter(pa.array(~np.isin(residents["rid"].to_numpy(), gone))) if len(gone) else residents
    return pa.concat_tables([stay, come.cast(stay.schema)]) if come.num_rows else stay


def _migrate(home: _Resident, books, kind, ints: str, counts: dict, salts: dict, member_rows: int, buckets: int):
    """The residents under new codebooks, their counts, the owners of each entry, and how many parts moved."""
    spark = home.spark
    moves = cut(_moves(home.read(), books, kind, ints), "moves")
    moved = 0
    for r in moves.groupBy("pos", "entry", F.col("x").isNull().alias("left")).count().collect():
        key = r["pos"], r["entry"]
        counts[key] = counts.get(key, 0) + (-r["count"] if r["left"] else r["count"])
        moved += r["count"] if r["left"] else 0
    if not moved:
        return home, salts, 0
    grown = _need(counts, member_rows, salts)
    table = _salt_table(spark, grown)
    notes = moves.where("x is null").unionByName(_salted(moves.where("x is not null").drop("salt"), table))
    wider = [k for k in grown if grown[k] > salts.get(k, 1)]
    if wider:  # members of an entry that needs more owners are dealt anew
        dealt = (home.read().join(F.broadcast(_salt_table(spark, {k: grown[k] for k in wider})), ["pos", "entry"])
                 .withColumn("to", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).where("to <> salt")
                 .join(moves.where("x is null").select("pos", "rid"), ["pos", "rid"], "left_anti"))
        dealt = cut(dealt.select("pos", "entry", "salt", "to", "rid", "x"), "dealt")
        notes = (notes.unionByName(dealt.select(*OWNER, "rid", F.lit(None).cast(f"array<{ints}>").alias("x")))
                 .unionByName(dealt.select("pos", "entry", F.col("to").alias("salt"), "rid", "x")))
    parts = (home.read().select(*OWNER, "rid", "x").groupBy(*OWNER).cogroup(notes.groupBy(*OWNER))
             .applyInArrow(_settled, f"pos int, entry int, salt int, rid bigint, x array<{ints}>"))
    after = _Resident(parts, buckets)
    home.forget()
    return after, grown, moved


def _salt_table(spark: SparkSession, salts: dict) -> DataFrame:
    return spark.createDataFrame([(p, e, n) for (p, e), n in salts.items()], "pos int, entry int, salts bigint")


def train(rows: DataFrame, start: list[np.ndarray], most: int, n: int, ints: str, rounds: int = 4,
          part_rows: int = 1 << 20, member_rows: int = 1 << 17) -> tuple[list[np.ndarray], list[int]]:
    """Codebooks after `rounds` rounds over (rid, x), and the number of parts that moved in each migration."""
    spark = rows.sparkSession
    positions, wide = len(start), start[0].shape[1]
    kind = _number(most, wide)
    books = [b.astype(kind) for b in start]
    inner = pa.int32() if ints == "int" else pa.int64()

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), kind)
                for p in range(positions):
                    part = x[:, p * wide:(p + 1) * wide]
                    near, _ = _assign(part, books[p])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(near.astype(np.int32)), batch.column(0),
                                                      lists(part.astype(np.int64), inner)], names=["pos", "entry", "rid", "x"])

    placed = rows.select("rid", "x").mapInArrow(first, f"pos int, entry int, rid bigint, x array<{ints}>")
    counts = {(r["pos"], r["entry"]): r["count"] for r in placed.groupBy("pos", "entry").count().collect()}
    salts = {(p, e): 1 for p in range(positions) for e in range(len(start[p]))} | _need(counts, member_rows)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-positions * n // part_rows))
    home = _Resident(_salted(placed, _salt_table(spark, salts)).repartition(buckets, *OWNER), buckets)
    moved = []
    try:
        for turn in range(rounds):
            counts, sums = _sums(home.read(), kind)
            new = [b.copy() for b in books]
            for (p, e), s in sums.items():
                new[p][e] = [s[j] // counts[p, e] for j in range(wide)]
            same = all((a == b).all() for a, b in zip(new, books))
            books = new
            if same:
                break
            if turn + 1 < rounds:  # the last assignment is the encoding itself
                home, salts, k = _migrate(home, books, kind, ints, counts, salts, member_rows, buckets)
                moved.append(k)
    finally:
        home.forget()
    return books, moved


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), positions: int = 4,
             entries: int = 256, rounds: int = 4, scale: int = 1024, part_rows: int = 1 << 20, member_rows: int = 1 << 17) -> dict:
    """Codes of all vectors: {"codes": (vec_id, kept, code, error), "codebooks": one integer matrix for each position, "moved": parts that
    changed owner in each migration}.

    Components become floor(scale * x); a vector is cut into `positions` equal parts, whose codebooks start as the
    parts of the `entries` smallest ids.  `code` lists the entry of each part, `error` is the sum of the squared distances; `kept` is a
    struct of the columns `keep`, so no name can clash.  Rows whose vector is null, empty or holds null or non-finite components are left
    out, and so are vectors of another than the commonest length (the shorter on ties).  A length that `positions` does not divide raises ValueError.
    Null ids come last and equal ids in the order of their vectors; repeated rows count and are returned as often as they occur.  With fewer than `entries` rows the
    codebooks are smaller.  Scaled components beyond the range of a long, and errors beyond it, are set to its ends.  An empty table gives no codes and empty codebooks.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("_"))
    good = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), kept.alias("kept"), doubles(vector_col).alias("vec")).where(finite())
    good, dims = of_commonest_length(good)
    if dims % positions:
        raise ValueError(f"vectors of {dims} components cannot be cut into {positions} equal parts")
    scaled = F.transform("vec", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    largest = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))
    rows = good.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "kept", scaled.alias("x"))
    found = rows.agg(F.max(largest).alias("most"), F.count("*").alias("n")).head() if dims else None
    if not found or not found["n"]:
        return {"codes": rows.select("vec_id", "kept", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false"), "codebooks": [], "moved": []}
    most = int(found["most"])
    ints = "int" if most < (1 << 31) - 1 else "bigint"
    rows = cut(rows.withColumn("x", F.col("x").cast(f"array<{ints}>")), "vectors")  # written once: the row numbers stay
    first = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()], dtype=object)
    wide = dims // positions
    start = [first[:, p * wide:(p + 1) * wide] for p in range(positions)]
    books, moved = train(rows, start, most, found["n"], ints, rounds, part_rows, member_rows)
    kind, top = _number(most, wide), (1 << 63) - 1

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), kind)
                made = [_assign(x[:, p * wide:(p + 1) * wide], books[p]) for p in range(positions)]
                error = [min(top, sum(int(d[k]) for _, d in made)) for k in range(len(x))]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.stack([near for near, _ in made], 1).astype(np.int32), pa.int32()),
                                                  pa.array(error, pa.int64()), batch.column(2)], names=["vec_id", "code", "error", "kept"])

    shape = rows.select("vec_id", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"), "kept").schema
    codes = rows.select("vec_id", "x", "kept").mapInArrow(encode, shape).select("vec_id", "kept", "code", "error")
    return {"codes": codes, "codebooks": [np.array([[int(v) for v in row] for row in b], dtype=object) for b in books], "moved": moved}
