"""Total order of events and dense ordinals.

The reference replays a log sorted on its timestamp.  Here the order is the
tuple ``(ts, event_id)``; ``event_id`` makes it total and stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.session import scratch_root

USER_ORDER = ("ts", "event_id")


def user_window(user: str = "user_id", order: Sequence[str] = USER_ORDER):
    return Window.partitionBy(user).orderBy(*order)


def global_ordinal(df: DataFrame, order: Sequence[str], out: str = "ord",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based ordinal following ``order`` (a zipWithIndex).

    No global window: the rows are range-partitioned on ``order`` (Spark
    samples the bounds), sorted inside each partition and written once with
    ``checkpoint()`` to the shared checkpoint folder.  The sampled bounds
    differ between executions, so the per-partition counts and the numbering
    must read the same materialised partitions; the checkpoint also cuts the
    lineage.  Rows are numbered locally with ``monotonically_increasing_id``
    and shifted by the row count of all earlier partitions.  The offset table
    has one row per partition, so its broadcast is bounded by the partition
    count, not by the data.  ``order`` must be unique.  Pass only the columns
    you need: all of them are materialised.
    """
    spark = df.sparkSession
    scratch_root(spark)
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(order)
    ranged = df.repartitionByRange(p, *cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    pid = F.spark_partition_id().cast("bigint")
    numbered = (ranged.withColumn("_pid", pid)
                .withColumn("_idx", F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_idx")).cast("bigint"))
            .drop("_pid", "_idx", "_off"))


def order_events(df: DataFrame) -> DataFrame:
    """Add ``pos``: the 0-based place of each event in its user's history."""
    from seqrec.operators import scan
    return scan.positions(df)


def event_order(df: DataFrame) -> DataFrame:
    """Global replay ordinal ``ord`` over ``(ts, event_id)`` plus per-user ``pos``."""
    return order_events(global_ordinal(df, USER_ORDER, out="ord"))
