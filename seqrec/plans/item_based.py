"""Item-based plan: blocks -> directed block similarity -> top-K -> top-N -> metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from seqrec.operators.evaluate import precision_recall
from seqrec.operators.recommend import recommend_item_neighbors
from seqrec.operators.similarity import block_item_similarity
from seqrec.operators.splits import holdout_last_n, test_part, train_part
from seqrec.operators.topk import topk_neighbors
from seqrec.session import cut


@dataclass(frozen=True)
class ItemBasedParams:
    gap: int = 10            # block gap in ts units (reference: 10 seconds)
    k: int = 30              # neighbours per item
    n: int = 10              # recommendations per user
    test_n: int | None = 2000
    test_pct: int | None = None
    flush_open: bool = False


def item_network(train: DataFrame, p: ItemBasedParams) -> DataFrame:
    sim = block_item_similarity(train, p.gap, flush_open=p.flush_open)
    return topk_neighbors(sim, p.k, src="src_item", dst="dst_item").withColumnRenamed(
        "src_item", "src").withColumnRenamed("dst_item", "dst")


def item_based(ratings: DataFrame, p: ItemBasedParams) -> dict[str, DataFrame]:
    """All intermediate frames of the item-based recommender (lazy)."""
    split = cut(holdout_last_n(ratings, n=p.test_n, test_pct=p.test_pct), "split")
    train, test = train_part(split), test_part(split)
    net = item_network(train, p)
    recs = recommend_item_neighbors(train, test, net, p.n)
    truth = test.join(train.select("user_id"), "user_id", "left_semi")
    metrics = precision_recall(recs, truth, population=test)
    return {"split": split, "train": train, "test": test, "network": net,
            "recs": recs, "metrics": metrics}
