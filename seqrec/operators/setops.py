"""Set operations on ``(user_id, item_id)`` relations (per-user item sets)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item_id")


def profile_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per user, items in both ``a`` and ``b`` (distinct)."""
    return _pairs(a).intersect(_pairs(b))


def profile_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per user, items in ``a`` or ``b`` (distinct)."""
    return _pairs(a).union(_pairs(b)).distinct()


def profile_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per user, items of ``a`` not in ``b`` (distinct; anti join)."""
    return _pairs(a).distinct().join(_pairs(b), ["user_id", "item_id"], "left_anti")
