"""Time-decayed pseudo-ratings for implicit feedback.

Ages are whole days before the split time ``t0``; an age falls into phase
``least(4, floor(days / phase_days))``.  The weight of a purchase is the
rating-scheme cell ``scheme[4 - i][4 - j]`` with ``scheme[a][b] = b + 0.2 *
(a + 1)``, i.e. ``(4 - j) + 0.2 * (5 - i)`` for item-age phase ``i`` and
purchase-age phase ``j``: recent purchases of new items weigh most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions.exprs import age_bucket

# The rating scheme is a 5 x 5 grid, phases are capped at 4.
PHASES = 5
SCHEME_STEP = 0.2
WEIGHT_DIGITS = 2


def scheme_value(a, b) -> Column:
    """``scheme[a][b] = b + 0.2 * (a + 1)`` as an expression (no lookup table)."""
    return F.lit(1.0) * b + F.lit(SCHEME_STEP) * (a + F.lit(1))


def item_launch_time(train: DataFrame) -> DataFrame:
    """First training timestamp per item: ``(item_id, launch_ts)``."""
    return train.groupBy("item_id").agg(F.min("ts").alias("launch_ts"))


def age_buckets(train: DataFrame, t0: Column, day_units: int, phase_days: int) -> DataFrame:
    """Adds ``i`` (item-age phase) and ``j`` (purchase-age phase) per training event."""
    launch = item_launch_time(train)
    top = PHASES - 1
    return (train.join(launch, "item_id")
            .withColumn("i", age_bucket(t0, F.col("launch_ts"), day_units, phase_days, top))
            .withColumn("j", age_bucket(t0, F.col("ts"), day_units, phase_days, top)))


def pseudo_ratings(train: DataFrame, t0: Column, day_units: int, phase_days: int) -> DataFrame:
    """Weight per (user, item) from its latest training purchase:
    ``(user_id, item_id, weight)`` rounded to 2 digits."""
    top = PHASES - 1
    b = age_buckets(train, t0, day_units, phase_days)
    latest = (b.groupBy("user_id", "item_id")
              .agg(F.max_by(F.struct("i", "j"), F.struct("ts", "event_id")).alias("_p")))
    w = scheme_value(F.lit(top) - F.col("_p.i"), F.lit(top) - F.col("_p.j"))
    return latest.select("user_id", "item_id", F.round(w, WEIGHT_DIGITS).alias("weight"))
