"""Rating factors and biases learned together, on a grid of user and item blocks.

``mu + b_u + b_i + p_u . q_i`` is fitted by gradient steps on the clamped error: every step moves both biases and both vectors of a rated pair.
Users and items lie in as many hash blocks each; in turn t of a round user block b meets item block (b + t) mod blocks, so the cells of a turn
share no row and run side by side, and after all turns of a round every rating was met.  A cell holds one block of each side, whatever the table's
size.  Ratings are added up per (user, item) first: a pair that was rated a million times is one row, a hot item has one row per user and thus
at most a block of users in any cell.  Order and first vectors are drawn by id, so partitioning changes nothing but the last digits of ``mu``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators.embeddings import adagrad_step, cell_keys as _keys
from seqrec.session import cut, scratch_path, ship


@dataclass(frozen=True)
class JointFactors:
    """``rounds`` over the grid with ``passes`` over a cell's ratings at each visit; ``rate`` and ``reg`` of the steps; ratings are clamped to
    ``low`` .. ``high``.  ``block_rows`` users or items and about ``cell_pairs`` pairs make a cell; a cell is one task's, so large cells leave cores idle."""

    rank: int = 100
    rounds: int = 10
    passes: int = 5
    rate: float = 0.02
    reg: float = 0.1
    low: float = 1.0
    high: float = 5.0
    batch: int = 1024
    block_rows: int = 250_000
    cell_pairs: int = 200_000
    seed: int = 339


_STATE = pa.schema([("id", pa.int64()), ("is_item", pa.bool_()), ("block", pa.int32()), ("bias", pa.float32()), ("bias_step", pa.float32()),
                    ("vec", pa.list_(pa.float32())), ("vec_step", pa.float32())])
_STATE_SQL = "id bigint, is_item boolean, block int, bias float, bias_step float, vec array<float>, vec_step float"


def rated_pairs(train: DataFrame) -> DataFrame:
    """``(user_id, item_id, n, total)``: how often a pair was rated and the sum of its ratings; rows with a null in any of the three are left out."""
    rows = train.select("user_id", "item_id", "rating").dropna()
    return rows.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@dataclass
class Side:
    """Rows of one side of a cell: biases and vectors with the squares their steps have seen."""

    bias: np.ndarray
    bias_step: np.ndarray
    vec: np.ndarray
    vec_step: np.ndarray

    def move(self, rows: np.ndarray, bias: np.ndarray, vec: np.ndarray, rate: float) -> None:
        adagrad_step(self.bias, self.bias_step, rows, bias[:, None], rate)
        adagrad_step(self.vec, self.vec_step, rows, vec, rate)


def train_cell(users: Side, items: Side, u: np.ndarray, i: np.ndarray, n: np.ndarray, total: np.ndarray, mu: float, p: JointFactors, rng) -> None:
    """Trains one cell in place: ``u``, ``i`` are places in the two sides, ``n`` and ``total`` the pair's ratings."""
    for _ in range(p.passes):
        order = rng.permutation(len(u))
        for at in range(0, len(order), p.batch):
            now = order[at:at + p.batch]
            a, b, k = u[now], i[now], n[now].astype(np.float32)
            x, y = users.vec[a], items.vec[b]
            raw = mu + users.bias[a, 0] + items.bias[b, 0] + (x * y).sum(1)
            error = (total[now] - k * np.clip(raw, p.low, p.high)).astype(np.float32)
            shrink = p.reg * k
            gradients = [(error - shrink * side.bias[rows, 0], error[:, None] * other - shrink[:, None] * own)
                         for side, rows, own, other in ((users, a, x, y), (items, b, y, x))]
            users.move(a, *gradients[0], p.rate)
            items.move(b, *gradients[1], p.rate)


def _side(table: pa.Table, rank: int) -> Side:
    floats = lambda name: table[name].to_numpy().astype(np.float32)
    vec = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, rank)
    return Side(floats("bias")[:, None], floats("bias_step").astype(np.float64), vec, floats("vec_step").astype(np.float64))


def _rows(table: pa.Table, side: Side, rank: int) -> pa.Table:
    offsets = pa.array(np.arange(len(side.vec) + 1, dtype=np.int64) * rank).cast(pa.int32())
    return pa.table([table["id"], table["is_item"], table["block"], pa.array(side.bias[:, 0]), pa.array(side.bias_step.astype(np.float32)),
                     pa.ListArray.from_arrays(offsets, pa.array(side.vec.reshape(-1))), pa.array(side.vec_step.astype(np.float32))], schema=_STATE)


def _cell(p: JointFactors, mu: float, lap: int, turn: int):
    def run(key, state, pairs):
        if not state.num_rows:
            return _STATE.empty_table()
        state = state.select(_STATE.names).cast(_STATE).sort_by("id")
        halves = [state.filter(pc.equal(state["is_item"], flag)) for flag in (False, True)]
        if not all(t.num_rows for t in halves) or not pairs.num_rows:
            return state
        pairs = pairs.sort_by([("user_id", "ascending"), ("item_id", "ascending")])
        u, i = (np.searchsorted(t["id"].to_numpy(), pairs[c].to_numpy()) for t, c in zip(halves, ("user_id", "item_id")))
        users, items = (_side(t, p.rank) for t in halves)
        rng = np.random.default_rng([p.seed, lap, turn, halves[0]["block"][0].as_py()])
        train_cell(users, items, u, i, pairs["n"].to_numpy(), pairs["total"].to_numpy(), mu, p, rng)
        return pa.concat_tables([_rows(t, side, p.rank) for t, side in zip(halves, (users, items))])

    return run


def _first(rows: DataFrame, p: JointFactors) -> DataFrame:
    """Biases at 0; vectors drawn from the id, of a length that does not grow with the rank."""
    span = 1 << 30
    draw = lambda k: (F.pmod(F.xxhash64("id", "is_item", k, F.lit(p.seed)), F.lit(span)) / float(span) - 0.5) * (0.5 / p.rank ** 0.5)
    vec = F.transform(F.sequence(F.lit(1), F.lit(p.rank)), draw).cast("array<float>")
    zero = F.lit(0.0).cast("float")
    return rows.select("id", "is_item", "block", zero.alias("bias"), zero.alias("bias_step"), vec.alias("vec"), zero.alias("vec_step"))


def train_joint_factors(train: DataFrame, p: JointFactors = JointFactors()) -> dict:
    """``mu``, ``user_bias (user_id, b_u)``, ``item_bias (item_id, b_i)``, ``users (user_id, vec)`` and ``items (item_id, vec)``.

    ``train``: ``(user_id, item_id, rating)``, ids any 64-bit numbers.  Without ratings the tables are empty and ``mu`` is null.
    """
    spark = train.sparkSession
    ship(spark)
    pairs = cut(rated_pairs(train.select(F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"), F.col("rating").cast("double"))), "rated-pairs")
    whole = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    ids = cut(pairs.select(F.col("user_id").alias("id"), F.lit(False).alias("is_item")).distinct()
              .unionByName(pairs.select(F.col("item_id").alias("id"), F.lit(True).alias("is_item")).distinct()), "rated-ids")
    most = max([r["count"] for r in ids.groupBy("is_item").count().collect()], default=0)
    blocks = max(-(-most // p.block_rows), round((whole["pairs"] / p.cell_pairs) ** 0.5), 1)
    mu = whole["total"] / whole["n"] if whole["n"] else None
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    state = cut(_first(ids.withColumn("block", of("id")), p), "factor-state")
    if whole["pairs"]:
        # a folder per turn: a turn reads its own cells only; rows of a turn are written by the task that holds their user block
        path = scratch_path(spark, "factor-cells")
        (pairs.withColumn("cell", of("user_id")).withColumn("turn", F.pmod(of("item_id") - F.col("cell"), F.lit(blocks)))
         .repartition("turn", "cell").write.mode("overwrite").partitionBy("turn").parquet(path))
        keys = F.array(*[F.lit(k).cast("bigint") for k in _keys(spark, blocks)])
        for lap in range(p.rounds):
            for turn in range(blocks):
                mine = spark.read.parquet(path).where(F.col("turn") == turn).select(keys[F.col("cell")].alias("of"), "user_id", "item_id", "n", "total")
                cells = state.withColumn("cell", keys[F.when(F.col("is_item"), F.pmod(F.col("block") - turn, F.lit(blocks))).otherwise(F.col("block"))])
                state = cut(cells.groupBy("cell").cogroup(mine.groupBy("of")).applyInArrow(_cell(p, mu, lap, turn), _STATE_SQL), "factor-state")
    half = lambda flag, name, bias: (state.where(F.col("is_item") == flag).select(F.col("id").alias(name), F.col("bias").cast("double").alias(bias), "vec"))
    users, items = half(False, "user_id", "b_u"), half(True, "item_id", "b_i")
    return {"mu": F.lit(mu).cast("double"), "user_bias": users.select("user_id", "b_u"), "item_bias": items.select("item_id", "b_i"),
            "users": users.select("user_id", "vec"), "items": items.select("item_id", "vec")}
