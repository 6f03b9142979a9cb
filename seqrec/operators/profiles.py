"""User profiles and the filters around them (long form, one row per event).

Profiles stay long -- ``(user_id, pos, item_id, ts, event_id)`` partitioned by
user -- instead of per-user arrays, so no task ever holds a whole history in
one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrec.operators import scan
from seqrec.operators.ordering import order_events, user_window


def user_profiles(df: DataFrame) -> DataFrame:
    """Time-ordered profile: every event with its 0-based ``pos`` (duplicates kept)."""
    return order_events(df).select("user_id", "pos", "item_id", "ts", "event_id")


def profile_positions(df: DataFrame) -> DataFrame:
    """Effective place of each distinct item: its first occurrence ``first_pos``."""
    return (order_events(df).groupBy("user_id", "item_id")
            .agg(F.min("pos").alias("first_pos")))


def profile_map(df: DataFrame) -> DataFrame:
    """Ordered-map view: one row per (user, item) with the first place and the
    timestamp of the *last* consumption (a re-insert overwrites the time but
    keeps the place)."""
    return (order_events(df).groupBy("user_id", "item_id")
            .agg(F.min("pos").alias("first_pos"),
                 F.max_by("ts", "pos").alias("last_ts")))


def active_users(df: DataFrame, min_items: int = 3) -> DataFrame:
    """Users with more than ``min_items`` distinct items: ``(user_id, n_items)``."""
    return (df.groupBy("user_id").agg(F.count_distinct("item_id").cast("bigint").alias("n_items"))
            .where(F.col("n_items") > min_items))


def known_users(test: DataFrame, reference: DataFrame) -> DataFrame:
    """Test rows whose user appears in ``reference`` (training or a network)."""
    return test.join(reference.select("user_id"), "user_id", "left_semi")


def unknown_users(test: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts of test events and distinct users without a reference profile."""
    cold = test.join(reference.select("user_id"), "user_id", "left_anti")
    return cold.agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                    F.count_distinct("user_id").cast("bigint").alias("users"))


def item_catalog(df: DataFrame) -> DataFrame:
    return df.select("item_id").distinct()


def recent_items(events: DataFrame, targets: DataFrame | Column, n: int = 3) -> DataFrame:
    """The last ``n`` items consumed strictly before each target event.

    ``events`` is the growing history (training plus test), ``targets`` the
    events to look back from, as a condition on ``events`` or a table.  Returns ``(event_id, user_id, back, item_id)``
    with ``back = 1`` the latest.
    """
    return scan.recent_items(events, targets, n)


def sample_items(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` pseudo-random distinct items per user (all when fewer).

    The draw is a hash of ``(item, seed)``: deterministic, and computed per
    user with a bounded top-n (WindowGroupLimit).
    """
    d = df.select("user_id", "item_id").distinct()
    drawn = F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.lit(str(seed))).cast("binary"))
    w = Window.partitionBy("user_id").orderBy(drawn, "item_id")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def ratings_summary(split: DataFrame) -> DataFrame:
    """One row: time range, distinct users / items and train / test sizes."""
    return split.agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.count_distinct("user_id").cast("bigint").alias("users"),
        F.count_distinct("item_id").cast("bigint").alias("items"),
        F.count_if(~F.col("is_test")).cast("bigint").alias("train_events"),
        F.count_if(F.col("is_test")).cast("bigint").alias("test_events"))


__all__ = ["user_profiles", "profile_positions", "profile_map", "active_users", "known_users",
           "unknown_users", "item_catalog", "recent_items", "sample_items", "ratings_summary",
           "user_window"]
