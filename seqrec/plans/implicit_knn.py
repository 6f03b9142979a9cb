"""Implicit-feedback kNN baseline: decayed pseudo-ratings, cosine user kNN,
votes from neighbours' training items, list-valued evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.operators.decay import pseudo_ratings
from seqrec.operators.knn import top_k_users
from seqrec.operators.splits import time_boundary
from seqrec.operators.topk import topk_per_key
from seqrec.session import cut


@dataclass(frozen=True)
class ImplicitParams:
    k: int = 50
    n: int = 10
    test_n: int | None = 2000
    test_pct: int | None = None
    day_units: int = 86_400      # ts units per day
    phase_days: int = 30
    measure: str = "cosine"      # or "jaccard"


def knn_network(train: DataFrame, t0, p: ImplicitParams) -> DataFrame:
    """``(user_id, neighbor_id, score, rank)``: top-k users by the chosen measure."""
    if p.measure == "jaccard":
        return top_k_users(train.select("user_id", "item_id").distinct().withColumn("weight", F.lit(1.0)), p.k, "jaccard")
    return top_k_users(pseudo_ratings(train, t0, p.day_units, p.phase_days), p.k)


def recommend_implicit_knn(train: DataFrame, test: DataFrame, net: DataFrame, n: int) -> DataFrame:
    """Per test event of a user with a training profile, the ``n`` items held by
    most neighbours (distinct training items, frozen) that the user has not
    consumed before the event.  Votes are fixed per user and computed once;
    only the seen-set changes between a user's test events.
    Returns ``(event_id, user_id, item_id, score, rank)``.
    """
    users = train.select("user_id").distinct()
    tev = test.join(users, "user_id", "left_semi").select("event_id", "user_id", "ts")
    held = train.select(F.col("user_id").alias("neighbor_id"), "item_id").distinct()
    votes = (net.join(tev.select("user_id").distinct(), "user_id", "left_semi")
             .join(held, "neighbor_id").groupBy("user_id", "item_id")
             .agg(F.count(F.lit(1)).cast("bigint").alias("score")))
    # Training items are seen at every test event; of the others an event can only rule out
    # what the user consumes in test, so the best n + (those items) candidates are enough.
    own = train.select("user_id", "item_id").distinct()
    later = (test.join(own, ["user_id", "item_id"], "left_anti").groupBy("user_id", "item_id")
             .agg(F.min(F.struct("ts", "event_id")).alias("_f")))
    spare = later.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    kept = (votes.join(own, ["user_id", "item_id"], "left_anti").join(spare, "user_id", "left")
            .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.lit(n) + F.coalesce("_c", F.lit(0)))
            .select("user_id", "item_id", "score"))
    cand = tev.join(kept.join(later, ["user_id", "item_id"], "left"), "user_id")
    seen = (F.col("_f.ts") < F.col("ts")) | ((F.col("_f.ts") == F.col("ts")) & (F.col("_f.event_id") < F.col("event_id")))
    fresh = cand.where(F.col("_f").isNull() | ~seen)
    top = topk_per_key(fresh, "event_id", "item_id", "score", n)
    return top.select("event_id", "user_id", "item_id", "score", "rank")


def implicit_knn(ratings: DataFrame, p: ImplicitParams) -> dict[str, DataFrame]:
    t0 = time_boundary(ratings, p.test_n, p.test_pct)
    split = cut(ratings.withColumn("is_test", F.coalesce(F.col("ts") >= t0, F.lit(False))), "split")
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    net = cut(knn_network(train, t0, p))
    recs = recommend_implicit_knn(train, test, net, p.n)
    return {"t0": t0, "train": train, "test": test, "network": net, "recs": recs}
