"""Metric sink: one JSON object per evaluation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str, seconds: float | None = None) -> None:
    """Writes the run's metrics; ``seconds`` is the time that the run reports for itself (null if not given)."""
    metrics.withColumn("seconds", F.lit(seconds).cast("double")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
