"""Largest inner products through norm blocks against the full product."""

import numpy as np
import pytest

from seqrec.operators import innerproduct as IP


def full(users, items):
    out = {}
    for u, p, need, seen in users:
        scored = sorted((-(np.round(np.dot(p, q) + b, 6)), i) for i, q, b in items if i not in (seen or []))
        out[u] = [(i, -s) for s, i in scored[:need]]
    return out


def run(spark, users, items, info=None):
    u = spark.createDataFrame([(k, p.tolist(), need, seen) for k, p, need, seen in users], "user_id bigint, vec array<float>, need int, seen array<bigint>")
    i = spark.createDataFrame([(k, q.tolist(), float(b)) for k, q, b in items], "item_id bigint, vec array<float>, bias double")
    out = {k: [] for k, *_ in users}
    for r in IP.top_products(u, i, info).collect():
        out[r["user_id"]].append((r["item_id"], r["raw"]))
    return {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in out.items()}


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_the_full_product(spark, monkeypatch, block):
    monkeypatch.setattr(IP, "ITEM_BLOCK", block)
    monkeypatch.setattr(IP, "USER_BLOCK", 5)
    monkeypatch.setattr(IP, "_CHUNK", 3)
    rng = np.random.default_rng(1)
    q = (rng.normal(size=(200, 6)) * rng.gamma(1, 1, size=(200, 1))).astype(np.float32)
    q[50:60] = q[0]  # ties
    items = [(7 * k % 200, v, round(float(b), 2)) for k, (v, b) in enumerate(zip(q, rng.normal(size=200)))]
    users = [(k, rng.normal(size=6).astype(np.float32), int(need), rng.choice(200, size, replace=False).tolist() if size else None)
             for k, (need, size) in enumerate(zip([1, 5, 5, 20, 40, 200, 300, 3], [0, 3, 50, 10, 100, 0, 20, 199]))]
    info = {}
    got, want = run(spark, users, items, info), full(users, items)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(abs(a - b) < 2e-6 for k in got for (_, a), (_, b) in zip(got[k], want[k]))
    assert info["visits"] <= info["possible"]


def test_blocks_of_small_norms_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(IP, "ITEM_BLOCK", 50)
    rng = np.random.default_rng(2)
    q = (rng.normal(size=(2000, 8)) * (np.arange(1, 2001)[:, None] ** -0.8)).astype(np.float32)
    items = [(k, v, 0.0) for k, v in enumerate(q)]
    users = [(k, rng.normal(size=8).astype(np.float32), 5, None) for k in range(30)]
    info = {}
    got, want = run(spark, users, items, info), full(users, items)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert info["visits"] < 0.25 * info["possible"]


def test_no_items_and_no_users(spark):
    assert run(spark, [(1, np.ones(2, np.float32), 3, None)], []) == {1: []}
    assert run(spark, [], [(1, np.ones(2, np.float32), 0.5)]) == {}
