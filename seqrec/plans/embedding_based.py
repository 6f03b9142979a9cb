"""Embedding-based plan: recent items -> cosine candidates -> top-N unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.session import cut

from seqrec.operators.profiles import recent_items
from seqrec.operators.splits import holdout_last_n
from seqrec.operators.topk import topk_per_key
from seqrec.operators.vectors import most_similar, normalize_vectors, query_vectors


def recommend_embeddings(ratings: DataFrame, vectors: DataFrame, ranks: DataFrame, n: int = 5,
                         test_n: int | None = 20000, test_pct: int | None = None,
                         recent: int = 3, topn: int = 100, skip_first: bool = True) -> dict[str, DataFrame]:
    """Per test event of a training user: the user's last ``recent`` items
    (training plus earlier test events) query the vectors; the first ``n``
    candidates not in the user's *training* items are recommended.

    ``vectors``: ``(item_id, vector)``; ``ranks``: ``(item_id, vocab_rank)``.
    Returns frames ``recs`` ``(event_id, user_id, item_id, sim, rank)``,
    ``test`` and ``train``.
    """
    split = cut(holdout_last_n(ratings, n=test_n, test_pct=test_pct, skip_first=skip_first), "split")
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    users = train.select("user_id").distinct()
    known = split.join(users, "user_id", "left_semi")
    targets = test.join(users, "user_id", "left_semi")
    pos = recent_items(known, F.col("is_test"), recent).select("event_id", "item_id")
    unit = normalize_vectors(vectors)
    q = query_vectors(pos, unit, ranks)
    cand = most_similar(q, unit, ranks, topn)
    owner = targets.select("event_id", "user_id")
    seen = train.select("user_id", "item_id").distinct()
    fresh = cand.join(owner, "event_id").join(seen, ["user_id", "item_id"], "left_anti")
    top = topk_per_key(fresh, "event_id", "item_id", "sim", n)
    recs = top.select("event_id", "user_id", "item_id", "sim", "rank")
    return {"recs": recs, "train": train, "test": test, "targets": targets, "candidates": cand}
