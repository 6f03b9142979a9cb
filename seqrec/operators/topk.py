"""Top-k per key with a deterministic tie-break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk_per_key(df: DataFrame, key, other: str, score: str, k: int,
                 rank: str = "rank") -> DataFrame:
    """Keep the ``k`` rows with the largest ``score`` per ``key``.

    Ties break on ``other`` ascending.  ``row_number() <= k`` lets Spark plan
    a WindowGroupLimit before the shuffle, so a key with a huge fan-out is cut
    to ``k`` rows per map task instead of arriving whole at one reducer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(other).asc())
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def topk_neighbors(sim: DataFrame, k: int, src: str = "src", dst: str = "dst",
                   score: str = "score") -> DataFrame:
    """Neighbour network ``(src, dst, score, rank)``: the k best ``dst`` per ``src``."""
    return topk_per_key(sim.select(src, dst, score), src, dst, score, k)
