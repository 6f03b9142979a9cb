"""Joint factors against a plain sequential version, on planted ratings and on awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.operators import jointfactors
from seqrec.operators import models as MD
from seqrec.operators.jointfactors import JointFactors, rated_pairs, train_joint_factors

keys_of = jointfactors._keys
SCHEMA = "user_id bigint, item_id bigint, rating double"


def tables(model):
    users = {r["user_id"]: (r["b_u"], list(r["vec"])) for r in model["user_bias"].join(model["users"], "user_id").collect()}
    items = {r["item_id"]: (r["b_i"], list(r["vec"])) for r in model["item_bias"].join(model["items"], "item_id").collect()}
    return users, items


def planted(n_users=60, n_items=40, rank=2, share=0.5, seed=5):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(0, 0.8, (n_users, rank)), rng.normal(0, 0.8, (n_items, rank))
    bu, bi = rng.normal(0, 0.5, n_users), rng.normal(0, 0.5, n_items)
    rows = [(u, i, float(np.clip(3 + bu[u] + bi[i] + p[u] @ q[i], 1, 5))) for u in range(n_users) for i in range(n_items) if rng.random() < share]
    order = rng.permutation(len(rows))
    cut = len(rows) * 4 // 5
    return [rows[k] for k in order[:cut]], [rows[k] for k in order[cut:]]


def plain(first, pairs, place, blocks, mu, p):
    """The same steps, one number at a time, over dicts."""
    sides = [{k: [b, list(v), 0.0, 0.0] for k, (b, v) in side.items()} for side in first]
    for lap in range(p.rounds):
        for turn in range(blocks):
            for cell in range(blocks):
                mine = sorted(r for r in pairs if place[r[0]] == cell and place[r[1]] == (cell + turn) % blocks)
                rng = np.random.default_rng([p.seed, lap, turn, cell])
                for _ in range(p.passes):
                    order = rng.permutation(len(mine))
                    for at in range(0, len(mine), p.batch):
                        sums = [{}, {}]
                        for k in order[at:at + p.batch]:
                            u, i, n, total = mine[k]
                            x, y = sides[0][u], sides[1][i]
                            raw = mu + x[0] + y[0] + sum(a * b for a, b in zip(x[1], y[1]))
                            error = total - n * min(max(raw, p.low), p.high)
                            for side, key, own, other in ((0, u, x, y), (1, i, y, x)):
                                g = sums[side].setdefault(key, [0.0, [0.0] * p.rank])
                                g[0] += error - p.reg * n * own[0]
                                g[1] = [s + error * o - p.reg * n * w for s, o, w in zip(g[1], other[1], own[1])]
                        for side in (0, 1):
                            for key, (gb, gv) in sums[side].items():
                                row = sides[side][key]
                                row[2] += gb * gb
                                row[3] += sum(g * g for g in gv) / p.rank
                                row[0] += p.rate * gb / math.sqrt(row[2] + 1e-10)
                                row[1] = [v + p.rate * g / math.sqrt(row[3] + 1e-10) for v, g in zip(row[1], gv)]
    return sides


@pytest.mark.parametrize("block_rows", [100, 7])
def test_equals_plain_steps(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(int(u), int(100 + i), float(r)) for u, i, r in zip(rng.integers(0, 18, 150), rng.integers(0, 12, 150), rng.integers(1, 6, 150))]
    train = spark.createDataFrame(rows, SCHEMA)
    p = JointFactors(rank=3, rounds=2, passes=2, rate=0.1, batch=8, block_rows=block_rows)
    first = tables(train_joint_factors(train, JointFactors(**{**p.__dict__, "rounds": 0})))
    got = tables(train_joint_factors(train, p))
    blocks = -(-len(first[0]) // block_rows)
    ids = spark.createDataFrame([(k,) for side in first for k in side], "id bigint")
    place = {r["id"]: r["b"] for r in ids.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).collect()}
    pairs = [tuple(r) for r in rated_pairs(train).collect()]
    want = plain(first, pairs, place, blocks, sum(r[2] for r in rows) / len(rows), p)
    for side in (0, 1):
        assert set(got[side]) == set(want[side])
        for k, (bias, vec) in got[side].items():
            assert abs(bias - want[side][k][0]) < 1e-3
            assert np.allclose(vec, want[side][k][1], atol=1e-3)


def test_partitioning_changes_nothing(spark):
    rows, _ = planted(20, 15)
    p = JointFactors(rank=4, rounds=2, passes=2, block_rows=6)
    one = tables(train_joint_factors(spark.createDataFrame(rows, SCHEMA).coalesce(1), p))
    many = tables(train_joint_factors(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), p))
    for a, b in zip(one, many):
        assert set(a) == set(b)
        assert all(abs(a[k][0] - b[k][0]) < 1e-5 and np.allclose(a[k][1], b[k][1], atol=1e-5) for k in a)


@pytest.mark.parametrize("block_rows", [1000, 25])
def test_learns_biases_and_factors_together(spark, block_rows):
    train, test = (spark.createDataFrame(rows, SCHEMA) for rows in planted())
    mae = lambda events: events.agg(F.avg(F.abs(F.col("prediction") - F.col("rating")))).first()[0]
    joint = train_joint_factors(train, JointFactors(rank=8, rounds=15, reg=0.02, rate=0.1, batch=64, block_rows=block_rows))
    biases = mae(MD.predict_clamped(test, MD.bias_baseline(train)))
    apart = mae(MD.factor_predictions(MD.train_factors(train, rank=8, reg=0.1), test))
    got = mae(MD.factor_predictions(joint, test))
    assert got < 0.75 * biases and got <= apart, (got, apart, biases)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, 10, 5.0)] * 500 + [(2, 10, 1.0), (1, 11, 2.0), (None, 10, 3.0), (3, None, 3.0), (4, 12, None)]
    train = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in rated_pairs(train).collect()) == [(1, 10, 500, 2500.0), (1, 11, 1, 2.0), (2, 10, 1, 1.0)]
    p = JointFactors(rank=2, rounds=2, passes=1)
    model = train_joint_factors(train, p)
    users, items = tables(model)
    assert set(users) == {1, 2} and set(items) == {10, 11}
    assert all(np.isfinite([b, *v]).all() for side in (users, items) for b, v in side.values())
    empty = train_joint_factors(train.where("false"), p)
    assert tables(empty) == ({}, {})
    assert MD.factor_predictions(empty, train.where("false")).count() == 0


def test_cells_grow_in_number_and_lie_apart(spark, monkeypatch):
    """The pairs of a large table make several cells, and no two cells of a turn share a partition."""
    laid = []
    monkeypatch.setattr(jointfactors, "_keys", lambda s, blocks: laid.append(keys_of(s, blocks)) or laid[-1])
    rows = spark.range(0, 10_000, 1, 4).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("item_id"), F.col("id").alias("user_id"), F.lit(3.0).alias("rating"))
    train_joint_factors(rows, JointFactors(rank=2, rounds=0))
    assert len(laid[0]) > 1  # a million pairs
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keys_of(spark, parts + 3)
    assert len(set(keys)) == parts + 3
    part = {r["id"]: r["p"] for r in spark.createDataFrame([(k,) for k in keys], "id bigint").select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).collect()}
    assert len({part[k] for k in keys[:parts]}) == parts
