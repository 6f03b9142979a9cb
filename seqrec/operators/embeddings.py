"""Skip-gram item vectors with negative sampling, trained on a grid of vocabulary blocks.

Words are dealt by hash into ``B`` blocks.  In round ``r`` of an epoch cell ``i`` trains the pairs of centres in block ``i`` with
contexts in block ``i + r``: cells of a round share no vector, so they run side by side without conflict,
and after ``B`` rounds every pair has been trained.  No machine holds more than two blocks of vectors.  ``B`` grows with the vocabulary
and with the number of pairs, so cells stay bounded.

Negatives of centre ``c`` are drawn in every cell in proportion to ``c``'s pairs and to the block's share of the noise
distribution (counts to the power 0.75), so in expectation the objective is that of plain negative sampling whatever the number of
blocks.  Steps are row-wise Adagrad, whose sums are kept with the vectors.  All draws are seeded by epoch, round and cell
and rows are sorted first, so the result does not depend on how Spark partitions the data.

A model is a table, one row per word.  Training from a model goes on where it stopped: known words keep
their vectors, step sizes and counts, new words are added.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.session import cut, path_exists, ship

# Fixed value: the usual exponent of the noise distribution.
NOISE_POWER = 0.75
MODEL = "word string, n bigint, center array<float>, center_step float, context array<float>, context_step float"
_STATE = pa.schema([("word", pa.string()), ("block", pa.int32()), ("n", pa.int64()), ("degree", pa.int64()), ("is_context", pa.bool_()), ("vec", pa.list_(pa.float32())), ("step", pa.float32())])
_STATE_SQL = "word string, block int, n bigint, degree bigint, is_context boolean, vec array<float>, step float"


@dataclass(frozen=True)
class SkipGram:
    size: int = 200
    window: int = 3
    negatives: int = 4
    epochs: int = 1
    rate: float = 0.05
    min_count: int = 1
    seed: int = 339
    batch: int = 256
    block_words: int = 65_536       # words of a block
    cell_pairs: int = 1_000_000     # pairs of a cell, about


def skip_pairs(corpus: DataFrame, window: int, seed: int) -> DataFrame:
    """``(center, context, n)``: how often words stand at most ``r`` places apart, ``r`` drawn from 1 to ``window`` at every centre by a hash."""
    reach = lambda i: F.pmod(F.xxhash64("tokens", i, F.lit(seed)), F.lit(window)).cast("int") + 1
    last = F.size("tokens") - 1
    others = lambda i: F.filter(F.sequence(F.greatest(i - reach(i), F.lit(0)), F.least(i + reach(i), last)), lambda j: j != i)
    pairs = F.flatten(F.transform("tokens", lambda t, i: F.transform(others(i), lambda j: F.struct(t.alias("center"), F.get(F.col("tokens"), j).alias("context")))))
    return (corpus.where(F.size("tokens") > 1).select(F.inline(pairs)).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n")))


def _alias(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables for drawing places in proportion to weights in constant time (Vose's method)."""
    scaled = (weights / weights.sum() * len(weights)).tolist()
    keep, other = np.ones(len(scaled)), np.arange(len(scaled))
    small = [k for k, w in enumerate(scaled) if w < 1]
    large = [k for k, w in enumerate(scaled) if w >= 1]
    while small and large:
        low, high = small.pop(), large.pop()
        keep[low], other[low] = scaled[low], high
        scaled[high] -= 1 - scaled[low]
        (small if scaled[high] < 1 else large).append(high)
    return keep, other


def _drawn(tables: tuple[np.ndarray, np.ndarray], n: int, rng) -> np.ndarray:
    keep, other = tables
    at = rng.integers(0, len(keep), n)
    return np.where(rng.random(n) < keep[at], at, other[at])


def adagrad_step(vectors: np.ndarray, steps: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One row-wise Adagrad step on the rows that occur."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    total = np.add.reduceat(gradient[order], first, axis=0)
    rows = rows[first]
    steps[rows] += (total * total).mean(1)
    vectors[rows] += rate * total / np.sqrt(steps[rows] + 1e-10)[:, None]


def train_cell(center: np.ndarray, center_step: np.ndarray, context: np.ndarray, context_step: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
               degree: np.ndarray, noise: np.ndarray, negatives: float, p: SkipGram, rng) -> None:
    """Trains one cell in place; ``negatives``: negatives of the cell for each of its pairs."""
    c, o, n = pairs
    noise_table = _alias(noise) if noise.sum() > 0 else None
    degree_table = _alias(degree.astype(float)) if degree.sum() > 0 else None
    order = rng.permutation(len(c))
    chunk = np.cumsum(n[order]) // (1 << 20)
    for part in np.unique(chunk):
        mine = order[chunk == part]
        each = rng.permutation(np.repeat(mine, n[mine]))
        for at in range(0, len(each), p.batch):
            now = each[at:at + p.batch]
            wanted = len(now) * negatives
            m = int(wanted) + int(rng.random() < wanted - int(wanted)) if noise_table and degree_table else 0
            rows = np.concatenate([c[now], _drawn(degree_table, m, rng)]) if m else c[now]
            columns = np.concatenate([o[now], _drawn(noise_table, m, rng)]) if m else o[now]
            x, y = center[rows], context[columns]
            label = np.zeros(len(rows), np.float32)
            label[:len(now)] = 1
            g = (label - 1 / (1 + np.exp(-np.clip((x * y).sum(1), -30, 30))))[:, None].astype(np.float32)
            adagrad_step(center, center_step, rows, g * y, p.rate)
            adagrad_step(context, context_step, columns, g * x, p.rate)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)


def _cell(p: SkipGram, epoch: int, turn: int, total_noise: float):
    def run(key, state, pairs):
        if not state.num_rows:
            return _STATE.empty_table()
        state = state.select(_STATE.names).sort_by([("is_context", "ascending"), ("word", "ascending")])
        is_context = state["is_context"].to_numpy(zero_copy_only=False)
        left, right = state.filter(pa.array(~is_context)), state.filter(pa.array(is_context))
        if not left.num_rows or not right.num_rows or not pairs.num_rows:
            return state.cast(_STATE)
        pairs = pairs.sort_by([("center", "ascending"), ("context", "ascending")])
        c = pc.index_in(pairs["center"], value_set=left["word"].combine_chunks()).to_numpy()
        o = pc.index_in(pairs["context"], value_set=right["word"].combine_chunks()).to_numpy()
        n = pairs["n"].to_numpy()
        center, context = _matrix(left["vec"], p.size), _matrix(right["vec"], p.size)
        steps = [t["step"].to_numpy().astype(np.float64) for t in (left, right)]
        degree, noise = left["degree"].to_numpy(), right["n"].to_numpy() ** NOISE_POWER
        negatives = p.negatives * degree.sum() * noise.sum() / total_noise / n.sum()
        rng = np.random.default_rng([p.seed, epoch, turn, left["block"][0].as_py()])
        train_cell(center, steps[0], context, steps[1], (c, o, n), degree, noise, negatives, p, rng)
        out = []
        for table, vectors, step in ((left, center, steps[0]), (right, context, steps[1])):
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * p.size)
            out.append(pa.table([table["word"], table["block"], table["n"], table["degree"], table["is_context"],
                                 pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1))), pa.array(step.astype(np.float32))], schema=_STATE))
        return pa.concat_tables(out)

    return run


def _begin(p: SkipGram):
    """Vectors of new words: the centre small and drawn by the word itself, the context zero."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words = batch.column(0).to_pylist()
                draw = lambda w: np.random.default_rng(int.from_bytes(blake2b(f"{p.seed}:{w}".encode(), digest_size=8).digest())).random(p.size, dtype=np.float32)
                first = [((draw(w) - 0.5) / p.size).tolist() for w in words]
                zeros = [[0.0] * p.size] * len(words)
                nothing = pa.array(np.zeros(len(words), np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.list_(pa.float32())), nothing, pa.array(zeros, pa.list_(pa.float32())), nothing],
                                                 names=["word", "center", "center_step", "context", "context_step"])
    return run


def cell_keys(spark: SparkSession, blocks: int) -> list[int]:
    """A key for each cell, so that cells go to partitions of their own as far as there are as many; hashes of 0, 1, 2 .. collide."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key")).orderBy("part")
    keys = [r["key"] for r in drawn.collect()]
    return [keys[c % len(keys)] + (c // len(keys)) * 64 * parts for c in range(blocks)]


def train_skip_gram(corpus: DataFrame, p: SkipGram = SkipGram(), model: DataFrame | None = None) -> DataFrame:
    """The model (schema ``MODEL``) after ``p.epochs`` epochs over ``tokens ARRAY<STRING>``, from scratch or from an earlier model.

    Words count over all batches so far; those with fewer than ``min_count`` occurrences are counted but get no vector yet, and are not returned by
    ``item_vectors``.  An empty corpus leaves the model as it is.
    """
    spark = corpus.sparkSession
    ship(spark)
    counts = corpus.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    old = spark.createDataFrame([], MODEL) if model is None else model
    both = counts.withColumnRenamed("n", "_new").join(old, "word", "full")
    known = cut(both.select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("n"), "center", "center_step", "context", "context_step"), "sgns-words")
    begun = known.where(F.col("center").isNull() & (F.col("n") >= p.min_count))
    fresh = begun.select("word").mapInArrow(_begin(p), "word string, center array<float>, center_step float, context array<float>, context_step float")
    words = cut(known.where(F.col("center").isNotNull()).unionByName(begun.select("word", "n").join(fresh, "word")), "sgns-begun")
    below = known.where(F.col("center").isNull() & (F.col("n") < p.min_count))
    for epoch in range(p.epochs):
        pairs = skip_pairs(corpus, p.window, p.seed + epoch)
        for side in ("center", "context"):
            pairs = pairs.join(words.select(F.col("word").alias(side)), side, "left_semi")
        pairs = cut(pairs, "sgns-pairs")
        whole = words.agg(F.count(F.lit(1)).alias("words"), F.sum(F.pow("n", F.lit(NOISE_POWER))).alias("noise")).first()
        total = pairs.agg(F.sum("n")).first()[0]
        if not total:
            break
        blocks = max(-(-whole["words"] // p.block_words), round((total / p.cell_pairs) ** 0.5), 1)
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        degree = pairs.groupBy(F.col("center").alias("word")).agg(F.sum("n").alias("degree"))
        rows = words.join(degree, "word", "left").select("word", of("word").alias("block"), "n", F.coalesce("degree", F.lit(0)).alias("degree"), F.inline(F.array(
            F.struct(F.lit(False).alias("is_context"), F.col("center").alias("vec"), F.col("center_step").alias("step")),
            F.struct(F.lit(True).alias("is_context"), F.col("context").alias("vec"), F.col("context_step").alias("step")))))
        state = cut(rows, "sgns-state")
        placed = pairs.withColumn("_c", of("center")).withColumn("_o", of("context"))
        keys = F.array(*[F.lit(k).cast("bigint") for k in cell_keys(spark, blocks)])
        # a number of partitions of our own: few bytes are much work here, and Spark would put the cells of a round into one task
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        alone = lambda df, c: df.repartition(parts, c).groupBy(c)
        for turn in range(blocks):
            cells = state.withColumn("cell", keys[F.when(F.col("is_context"), F.pmod(F.col("block") - turn, F.lit(blocks))).otherwise(F.col("block"))])
            mine = placed.where(F.col("_o") == F.pmod(F.col("_c") + turn, F.lit(blocks))).select(keys[F.col("_c")].alias("of"), "center", "context", "n")
            state = cut(alone(cells, "cell").cogroup(alone(mine, "of")).applyInArrow(_cell(p, epoch, turn, whole["noise"]), _STATE_SQL), "sgns-state")
        half = lambda flag, name: state.where(F.col("is_context") == flag).select("word", *(["n"] if not flag else []), F.col("vec").alias(name), F.col("step").alias(f"{name}_step"))
        words = cut(half(False, "center").join(half(True, "context"), "word"), "sgns-begun")
    return words.unionByName(below.select(*words.columns)).select("word", "n", "center", "center_step", "context", "context_step")


def item_vectors(model: DataFrame) -> DataFrame:
    """``(item_id, vector ARRAY<DOUBLE>)`` of the words that have a vector."""
    return model.where("center is not null").select(F.col("word").cast("bigint").alias("item_id"), F.col("center").cast("array<double>").alias("vector"))


# ---------------------------------------------------------------- a model that is trained further


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version below ``path``; none if there is no model yet."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, path) if version is None else version
    return spark.read.schema(MODEL).parquet(f"{path.rstrip('/')}/version={version}")


def extend_model(corpus: DataFrame, path: str, p: SkipGram = SkipGram()) -> int:
    """Trains the newest version below ``path`` (or a first one) further on a batch and writes the next version, whose number is returned.

    Earlier versions stay, so a failed run leaves the model as it was."""
    spark = corpus.sparkSession
    version = latest_version(spark, path)
    model = train_skip_gram(corpus, p, None if version is None else load_model(spark, path, version))
    following = 0 if version is None else version + 1
    model.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={following}")
    return following
