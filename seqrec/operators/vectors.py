"""Item vectors: normalisation, vocabulary ranks, cosine neighbours, and
embedding-based recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions.exprs import unit_vector
from seqrec.operators.ordering import global_ordinal
from seqrec.operators.topk import topk_per_key

SIM_DIGITS = 6
# Fixed values of the candidate search: lists of at least 60 candidates are
# requested from the first R vocabulary entries, R growing 20, 20, 30, 40, ...
MIN_CANDIDATES = 60
WIDEN_STEP = 10


def normalize_vectors(vectors: DataFrame) -> DataFrame:
    """L2 unit vectors ``(item_id, vector)``."""
    return vectors.select("item_id", unit_vector("vector").alias("vector"))


def vectors_long(vectors: DataFrame, digits: int = SIM_DIGITS) -> DataFrame:
    """``(item_id, dim, value)`` rows, values rounded."""
    return vectors.select("item_id", F.posexplode("vector").alias("dim", "value")).select(
        "item_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", digits).alias("value"))


def vocab_ranks(corpus_tokens: DataFrame) -> DataFrame:
    """Vocabulary by corpus frequency: ``(item_id, freq, vocab_rank)``.

    ``corpus_tokens`` has one row per token occurrence (``item_id``).  Rank
    0 is the most frequent item, ties by id.  The ranking is a range-
    partitioned ordinal, not a single-partition window.
    """
    freq = corpus_tokens.groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))
    ranked = global_ordinal(freq.withColumn("_nf", -F.col("freq")), ["_nf", "item_id"], out="vocab_rank")
    return ranked.select("item_id", "freq", "vocab_rank")


def candidate_vocab_size(positive_ranks: Column, vocab_size: Column) -> Column:
    """Closed form of the widening loop: ``R = 60`` unless a positive sits in
    the first 60 entries (then ``R = 70``: at most 3 positives), capped at the
    vocabulary size (the loop would never end below 60 entries)."""
    hit = F.exists(positive_ranks, lambda r: r < F.lit(MIN_CANDIDATES))
    r = F.when(hit, F.lit(MIN_CANDIDATES + WIDEN_STEP)).otherwise(F.lit(MIN_CANDIDATES))
    return F.least(r.cast("bigint"), vocab_size)


def query_vectors(positives: DataFrame, unit: DataFrame, ranks: DataFrame) -> DataFrame:
    """Positives of each query: ``(event_id, pos_vecs, pos_items, pos_ranks)``.

    ``positives``: ``(event_id, item_id)`` rows (duplicates weigh twice);
    unknown items are skipped.  At most ``recent`` vectors per query.
    """
    j = positives.join(unit, "item_id").join(ranks.select("item_id", "vocab_rank"), "item_id")
    return j.groupBy("event_id").agg(F.collect_list("vector").alias("pos_vecs"),
                                     F.collect_set("item_id").alias("pos_items"),
                                     F.collect_set("vocab_rank").alias("pos_ranks"))


def _cosine_scorer(head: np.ndarray):
    """Mean of a query's unit vectors, renormalised, dotted with every row of
    ``head`` (the bounded vocabulary head): one matrix product per Arrow batch."""
    @F.arrow_udf("array<double>")
    def score(queries: pa.Array) -> pa.Array:
        counts = pc.list_value_length(queries).to_numpy(zero_copy_only=False)
        vectors = queries.flatten()
        x = np.asarray(vectors.flatten()).reshape(len(vectors), -1)
        mean = np.add.reduceat(x, np.cumsum(counts) - counts) / counts[:, None]
        size = np.sqrt((mean * mean).sum(1, keepdims=True))
        out = np.divide(mean, size, out=mean, where=size > 0) @ head.T
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(head), dtype=np.int32), out.ravel())
    return score


def most_similar(queries: DataFrame, unit: DataFrame, ranks: DataFrame, topn: int = 100) -> DataFrame:
    """Cosine neighbours of each query among the first ``R`` vocabulary entries
    (``R`` from ``candidate_vocab_size``), positives excluded, best ``topn``.

    The searched vocabulary has at most ``MIN_CANDIDATES + WIDEN_STEP``
    entries whatever the data size, so it is shipped to the tasks as a small
    matrix and scored with one matrix product per batch inside an
    Arrow-batched UDF.  Returns ``(event_id, item_id, sim, sim_rank)``.
    """
    limit = MIN_CANDIDATES + WIDEN_STEP
    vocab_size = ranks.select(F.count(F.lit(1)).cast("bigint")).scalar()
    rows = (ranks.where(F.col("vocab_rank") < limit).join(unit, "item_id")
            .select("item_id", "vocab_rank", "vector").orderBy("vocab_rank").collect())  # <= limit rows
    if not rows:
        return queries.sparkSession.createDataFrame(
            [], "event_id bigint, item_id bigint, sim double, sim_rank bigint")
    head = np.array([np.asarray(r.vector, dtype=np.float64) for r in rows])
    ids = F.array(*[F.lit(int(r.item_id)).cast("bigint") for r in rows])
    vranks = F.array(*[F.lit(int(r.vocab_rank)).cast("bigint") for r in rows])
    q = queries.withColumn("_r", candidate_vocab_size(F.col("pos_ranks"), vocab_size))
    c = q.select("event_id", "pos_items", "_r",
                 F.posexplode(_cosine_scorer(head)(F.col("pos_vecs"))).alias("_k", "_s"))
    c = (c.withColumn("item_id", F.element_at(ids, F.col("_k") + 1))
         .where((F.element_at(vranks, F.col("_k") + 1) < F.col("_r"))
                & ~F.array_contains("pos_items", F.col("item_id"))))
    sims = c.select("event_id", "item_id", F.round("_s", SIM_DIGITS).alias("sim"))
    return topk_per_key(sims, "event_id", "item_id", "sim", topn, rank="sim_rank")
