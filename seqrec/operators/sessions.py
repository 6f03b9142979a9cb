"""Time-gap sessions over the ordered-map profile, and the token corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators import scan
from seqrec.operators.profiles import profile_map


def user_sessions(df: DataFrame, gap, min_items: int = 3) -> DataFrame:
    """Sessions of users with more than ``min_items`` distinct items.

    Walks the ordered-map profile (one row per item at its *first* place,
    carrying its *last* timestamp).  A session starts at the first item and
    whenever ``ts - previous ts > gap``; a re-consumed item can therefore
    carry a later time than its successor (negative gap: no break).
    Returns ``(user_id, session_id, n, item_id, first_pos, last_ts)``.
    """
    pm = profile_map(df)
    sizes = pm.groupBy("user_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > min_items)
    pm = pm.join(sizes.select("user_id"), "user_id", "left_semi")
    seg = scan.gap_segments(pm, gap, order=("first_pos",), ts_col="last_ts")
    return seg.select("user_id", "session_id", "n", "item_id", "first_pos", "last_ts")


def session_corpus(sessions: DataFrame) -> DataFrame:
    """Token sentences ``(user_id, session_id, tokens ARRAY<STRING>)``, one per session, never cut.

    A sentence is one value, as the trainer needs it; sessions are bounded by the gap.
    """
    return (sessions.groupBy("user_id", "session_id")
            .agg(F.array_sort(F.collect_list(F.struct("n", F.col("item_id").cast("string").alias("t")))).alias("_s"))
            .select("user_id", "session_id", F.col("_s.t").alias("tokens")))


def session_sentences(sessions: DataFrame) -> DataFrame:
    """Space-joined sentence per session: ``(user_id, session_id, sentence)``."""
    return session_corpus(sessions).select("user_id", "session_id", F.array_join("tokens", " ").alias("sentence"))
