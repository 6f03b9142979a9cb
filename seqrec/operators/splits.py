"""Time-based hold-out splits.

Both splits mark rows with ``is_test`` instead of returning two frames so
that one scan feeds both sides.  The boundary is one key, found by histograms
of a fixed number of buckets at every size: no global window, sort or top-n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of one histogram; what reaches the driver in one step.
STEP_BUCKETS = 1 << 14


def _nth_largest(keys: DataFrame, n: int, rows: int, lo: int, hi: int) -> tuple[int, int]:
    """The ``n``-th largest ``(ts, event_id)`` of ``rows`` keys with ``lo <= ts <= hi``, ``1 <= n <= rows``.

    One histogram of ``STEP_BUCKETS`` equal ranges finds the range that holds the key; the next one splits that
    range, first of ``ts``, then, among equal times, of ``event_id``.  As soon as a range holds no more than ``STEP_BUCKETS`` keys,
    they are read themselves.  Every step is one partial aggregation; what reaches the driver is bounded.
    """
    name = "ts"
    while rows > STEP_BUCKETS:
        if lo == hi and name == "ts":
            name, keys = "event_id", keys.where(F.col("ts") == F.lit(lo))
            ends = keys.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
            lo, hi = ends["lo"], ends["hi"]
        if lo == hi:  # repeated keys
            break
        width = (hi - lo) // STEP_BUCKETS + 1
        inside = keys.where((F.col(name) >= F.lit(lo)) & (F.col(name) <= F.lit(hi)))
        counts = inside.groupBy(F.expr(f"({name} - ({lo}L)) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        for b, rows in sorted(((r["b"], r["c"]) for r in counts.collect()), reverse=True):
            if n <= rows:
                break
            n -= rows
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    inside = keys.where((F.col(name) >= F.lit(lo)) & (F.col(name) <= F.lit(hi)))
    if rows > STEP_BUCKETS:
        return tuple(inside.select("ts", "event_id").first())
    return sorted(map(tuple, inside.select("ts", "event_id").collect()), reverse=True)[n - 1]


def _newest_boundary(df: DataFrame, n: int | None, test_pct: int | None) -> Column:
    """Struct ``(ts, event_id)`` of the n-th newest event, as a literal; null if ``n`` is 0.

    Events without a time count as older than all others and are never the boundary.
    """
    if (n is None) == (test_pct is None):
        raise ValueError("give exactly one of n or test_pct")
    keys = df.select("ts", "event_id")
    whole = keys.agg(F.count(F.lit(1)).alias("all"), F.count("ts").alias("timed"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    n = int(n) if n is not None else (whole["all"] * int(test_pct)) // 100
    n = min(n, whole["timed"])
    if n <= 0:
        return F.lit(None).cast("struct<ts:bigint,event_id:bigint>")
    ts, event_id = _nth_largest(keys.where("ts is not null"), n, whole["timed"], whole["lo"], whole["hi"])
    return F.struct(F.lit(ts).cast("bigint").alias("ts"), F.lit(event_id).cast("bigint").alias("event_id"))


def _at_or_after(b: Column, strict: bool = False) -> Column:
    later = (F.col("ts") > b.getField("ts"))
    tie = (F.col("ts") == b.getField("ts")) & (
        (F.col("event_id") > b.getField("event_id")) if strict else (F.col("event_id") >= b.getField("event_id")))
    return F.coalesce(later | tie, F.lit(False))


def holdout_last_n(df: DataFrame, n: int | None = None, test_pct: int | None = None,
                   skip_first: bool = False) -> DataFrame:
    """Newest ``n`` events (or ``test_pct`` percent) by ``(ts, event_id)`` are test.

    Adds ``is_test``; rows are not moved, only the boundary key is computed.
    ``skip_first`` reproduces the embedding script's off-by-one: the oldest
    event is dropped, the boundary event trains, and the test set is ``n - 1``
    events long.
    """
    b = _newest_boundary(df, n, test_pct)
    if skip_first:
        oldest = df.select(F.min(F.struct("ts", "event_id")).alias("k")).first()["k"]
        if oldest is None:
            return df.withColumn("is_test", F.lit(False))
        first = F.struct(F.lit(oldest["ts"]).cast("bigint").alias("ts"), F.lit(oldest["event_id"]).cast("bigint").alias("event_id"))
        return (df.where(_at_or_after(first, strict=True))
                .withColumn("is_test", _at_or_after(b, strict=True)))
    return df.withColumn("is_test", _at_or_after(b))


def time_boundary(df: DataFrame, n: int | None = None, test_pct: int | None = None) -> Column:
    """Timestamp of the ``n``-th newest event."""
    return _newest_boundary(df, n, test_pct).getField("ts")


def holdout_by_time(df: DataFrame, n: int | None = None, test_pct: int | None = None) -> DataFrame:
    """Threshold split: the ``n``-th newest timestamp starts the test period.

    Training is strictly earlier, so events sharing the boundary timestamp all
    go to test (test may exceed ``n``).  Adds ``is_test``.
    """
    return df.withColumn("is_test", F.coalesce(F.col("ts") >= time_boundary(df, n, test_pct), F.lit(False)))


def train_part(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_test"))


def test_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_test"))
