"""Hold-out evaluation: precision, recall, MAE and run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_DIGITS = 6


def _per_user(recs: DataFrame, truth: DataFrame, listed) -> DataFrame:
    """``(user_id, r_n, t_n, h_n)`` of users with recommendations and truth; ``recs`` is read once.

    ``listed`` aggregates a user's distinct items, ``_m`` being how often each was recommended.
    """
    r = recs.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_m"))
    t = truth.select("user_id", "item_id").distinct()
    t_size = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("t_n"))
    hit = r.hint("merge").join(t.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left")
    return hit.groupBy("user_id").agg(listed.alias("r_n"), F.count("_hit").alias("h_n")).hint("merge").join(t_size, "user_id")


def precision_recall(recs: DataFrame, truth: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Macro precision / recall over users with a non-empty recommendation set.

    ``recs`` and ``truth`` hold ``(user_id, item_id)`` rows (duplicates
    ignored: both are sets).  ``population`` lists the users the run kept a
    (possibly empty) list for -- default: the users of ``truth``.  One row:
    ``precision, recall, users`` (scored users) and ``norec`` (population
    users without recommendations).  No scored user gives null metrics.
    """
    per_user = _per_user(recs, truth, F.count(F.lit(1)))
    metrics = per_user.agg(
        F.round(F.avg(F.col("h_n") / F.col("r_n")), METRIC_DIGITS).alias("precision"),
        F.round(F.avg(F.col("h_n") / F.col("t_n")), METRIC_DIGITS).alias("recall"),
        F.count(F.lit(1)).cast("bigint").alias("users"))
    pop = population if population is not None else truth
    n_pop = pop.select(F.count_distinct("user_id").cast("bigint")).scalar()
    return metrics.withColumn("norec", (n_pop - F.col("users")).cast("bigint"))


def precision_recall_multiset(rec_list: DataFrame, truth: DataFrame) -> DataFrame:
    """List-valued variant: the precision denominator is the length of the
    accumulated list *with* duplicates, hits and recall use distinct items.
    Users of ``truth`` with an empty list are left out (their precision is
    undefined).  One row: ``precision, recall, users``."""
    per_user = _per_user(rec_list, truth, F.sum("_m"))
    return per_user.agg(
        F.round(F.avg(F.col("h_n") / F.col("r_n")), METRIC_DIGITS).alias("precision"),
        F.round(F.avg(F.col("h_n") / F.col("t_n")), METRIC_DIGITS).alias("recall"),
        F.count(F.lit(1)).cast("bigint").alias("users"))


def mae(pred: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """Mean absolute error over all rows: ``(mae, events)``."""
    return pred.agg(F.round(F.avg(F.abs(F.col(prediction) - F.col(label))), METRIC_DIGITS).alias("mae"),
                    F.count(F.lit(1)).cast("bigint").alias("events"))
