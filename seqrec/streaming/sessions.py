"""Gap sessions on a stream by Spark's own session windows: no Python, state of one row per open session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.session import scratch_path
from seqrec.streaming.similarity import _replay

#: Sessions as they are put out; times in the unit of ``ts``, microseconds.
SESSION_SCHEMA = "user_id bigint, first_ts bigint, last_ts bigint, events bigint"


def stream_sessions(events: DataFrame, gap: int, delay: int = 0) -> DataFrame:
    """``(user_id, first_ts, last_ts, events)`` of a streaming ``events`` frame, each session once it is over.

    A session ends when the next event of its user comes more than ``gap`` later, as in ``gap_sessions``.  It is put out when the
    watermark, ``delay`` behind the newest event, has passed its end; events older than that are dropped by Spark.
    Spark keeps watermarks in whole milliseconds, so a session may be put out up to that much later.  Events without a user or a time belong to no session.
    """
    at = events.where("user_id is not null and ts is not null").withColumn("at", F.timestamp_micros("ts"))
    window = F.session_window("at", f"{int(gap)} microseconds")  # an event at the very end of a window still extends it
    return (at.withWatermark("at", f"{int(delay)} microseconds").groupBy("user_id", window)
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
            .select("user_id", "first_ts", "last_ts", "events"))


def run_stream_sessions(spark: SparkSession, source: list[str], gap: int, delay: int = 0, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All sessions of staged chunks, replayed one micro-batch after another.

    A chunk of one event far after the last lets the watermark pass every session; its own stays open."""
    out = out or scratch_path(spark, "stream-sessions")
    checkpoint = checkpoint or scratch_path(spark, "stream-sessions-ckpt")
    end = scratch_path(spark, "stream-sessions-end")
    last = spark.read.parquet(*source).agg(F.max("ts").alias("ts"))
    marker = last.where("ts is not null").select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("rating"),
                                                 (F.col("ts") + 2 * (int(gap) + int(delay)) + 10_000).alias("ts"), F.lit(0).cast("bigint").alias("event_id"))
    marker.write.parquet(end)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _replay(spark, [*source, end], checkpoint, lambda events: stream_sessions(events, gap, delay).writeStream.outputMode("append").foreachBatch(sink))
    return spark.read.schema(f"{SESSION_SCHEMA}, batch int").parquet(out).drop("batch")
