"""Exact top-k neighbours with pruning against all pairs."""

import math
import random

import pytest

from seqrec.operators import knn
from seqrec.operators.neighbors import cosine_user_similarity, jaccard_user_similarity
from seqrec.operators.topk import topk_per_key


def all_pairs(rows, k, measure):
    """Every pair with a common item, then the k best, ties to the smaller id."""
    users = {}
    for u, i, w in rows:
        users.setdefault(u, {})[i] = w
    out = {}
    for u, a in users.items():
        found = []
        for v, b in users.items():
            common = sorted(set(a) & set(b))
            if u == v or not common:
                continue
            if measure == "cosine":
                s = sum(a[i] * b[i] for i in common) / (math.sqrt(sum(w * w for w in a.values())) * math.sqrt(sum(w * w for w in b.values())))
            else:
                s = len(common) / (len(a) + len(b) - len(common))
            found.append((-math.floor(s * 1e6 + 0.5) / 1e6, v))
        for rank, (s, v) in enumerate(sorted(found)[:k], 1):
            out[u, rank] = (v, -s)
    return out


def log(seed, users=60, items=40, communities=1):
    rng = random.Random(seed)
    rows = {}
    for u in range(users):
        own = rng.randrange(communities)
        for _ in range(rng.choice([1, 3, 8, 20])):
            i = own * 1000 + int(rng.paretovariate(1)) % items if rng.random() < 0.95 else 999_999
            rows[u, i] = rng.choice([0.5, 1.0, 2.2, 4.8])
    rows |= {(u, 5): 1.0 for u in range(users, users + 8)}  # ties
    return [(u, i, w) for (u, i), w in rows.items()]


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
@pytest.mark.parametrize("seed,block_users,visitors", [(1, 2048, 2048), (2, 7, 5), (3, 20, 3)])
def test_equals_all_pairs(spark, monkeypatch, measure, seed, block_users, visitors):
    monkeypatch.setattr(knn, "VISITORS", visitors)
    monkeypatch.setattr(knn, "_CHUNK", 4)
    rows = log(seed, communities=3)
    if measure == "jaccard":
        rows = [(u, i, 1.0) for u, i, _ in rows]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    got = {(r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in knn.top_k_users(df, 4, measure, block_users).collect()}
    assert got == all_pairs(rows, 4, measure)
    sim = (cosine_user_similarity(df) if measure == "cosine" else jaccard_user_similarity(df)).withColumnsRenamed({"user_a": "user_id", "user_b": "neighbor_id"})
    pairs = {(r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in topk_per_key(sim, "user_id", "neighbor_id", "score", 4).collect()}
    assert {k: v[0] for k, v in pairs.items()} == {k: v[0] for k, v in got.items()}


def test_bounds_prune_blocks_and_pairs(spark):
    """Users of one community need not visit the blocks of others, and few pairs are emitted."""
    rows = log(5, users=600, items=15, communities=12)
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    info = {}
    got = {(r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in knn.top_k_users(df, 3, block_users=50, info=info).collect()}
    assert got == all_pairs(rows, 3, "cosine")
    assert info["first"] + info["rest"] < 0.7 * info["users"] * info["blocks"]
    pairs = sum(1 for _ in cosine_user_similarity(df).collect())
    assert info["emitted"] * 5 < pairs


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
@pytest.mark.parametrize("stripe,stripes", [(10 ** 9, 1), (1500, 4)])
def test_a_stripe_of_blocks_sends_k_members_at_most(spark, monkeypatch, measure, stripe, stripes):
    """Users on common items visit all blocks; what they send grows with the stripes and not with the blocks."""
    monkeypatch.setattr(knn, "STRIPE", stripe)
    monkeypatch.setattr(knn, "VISITORS", 37)
    rng = random.Random(8)
    rows = [(u, i, 1.0 if measure == "jaccard" else rng.choice([0.5, 1.0, 2.2])) for u in range(200) for i in rng.sample(range(40), 25)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    info = {}
    got = {(r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in knn.top_k_users(df, 3, measure, 10, info=info).collect()}
    assert got == all_pairs(rows, 3, measure)
    assert info["blocks"] == 20 and info["rest"] > 15 * info["users"]
    assert info["emitted"] <= (1 + stripes) * 3 * info["users"]


def test_no_rows_and_no_common_item(spark):
    schema = "user_id bigint, item_id bigint, weight double"
    assert knn.top_k_users(spark.createDataFrame([], schema), 3).count() == 0
    assert knn.top_k_users(spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], schema), 3).count() == 0


def counts_by_version(rows, k, versions):
    """{(version, user, rank): (neighbour, common items born by then)}."""
    out = {}
    for version in range(versions):
        users = {}
        for u, i, b in rows:
            if b <= version:
                users.setdefault(u, set()).add(i)
        for u, a in users.items():
            best = sorted((-len(a & b), v) for v, b in users.items() if v != u and a & b)[:k]
            out |= {(version, u, r): (v, -c) for r, (c, v) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed,block_users,visitors", [(1, 2048, 2048), (2, 9, 4)])
def test_versions_of_common_items(spark, monkeypatch, seed, block_users, visitors):
    monkeypatch.setattr(knn, "VISITORS", visitors)
    monkeypatch.setattr(knn, "_CHUNK", 8)
    rng = random.Random(seed)
    rows = [(u, i, rng.choice([0, 0, 1, 2, 3])) for u, i, _ in log(seed, communities=3)]
    df = spark.createDataFrame([(u, i // 7, i % 7, b) for u, i, b in rows], "user_id bigint, a bigint, b bigint, born int")
    got = knn.top_k_users(df, 4, "count", block_users, ("a", "b"), versions=4).collect()
    assert {(r["version"], r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in got} == counts_by_version(rows, 4, 4)
    all_ = knn.products(df.drop("born"), ("a", "b"), block_users=block_users).collect()
    every = counts_by_version([(u, i, 0) for u, i, _ in rows], 10 ** 6, 1)
    assert {(r["user_id"], r["neighbor_id"], r["score"]) for r in all_} == {(u, v, c) for (_, u, _), (v, c) in every.items()}
    assert len(all_) == len(every)


@pytest.mark.parametrize("seed,block_users", [(1, 2048), (2, 9)])
def test_intervals_hold_every_score_once(spark, monkeypatch, seed, block_users):
    monkeypatch.setattr(knn, "_CHUNK", 8)
    rng = random.Random(seed)
    rows = [(u, i, rng.choice([0, 0, 1, 2, 3])) for u, i, _ in log(seed, users=25, communities=2)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, born int")
    got = knn.count_intervals(df, ("item_id",), 4, block_users).collect()
    by = {}
    for r in got:
        assert r["user_id"] < r["neighbor_id"] and r["version"] <= r["until"]
        for version in range(r["version"], r["until"] + 1):
            assert (version, r["user_id"], r["neighbor_id"]) not in by  # intervals of a pair do not overlap
            by[version, r["user_id"], r["neighbor_id"]] = r["score"]
    want = {(version, u, v): c for (version, u, _), (v, c) in counts_by_version(rows, 10 ** 6, 4).items() if u < v}
    assert by == want
    changes = sum(1 for (version, u, v), c in want.items() if want.get((version - 1, u, v)) != c)
    assert len(got) == changes


@pytest.mark.parametrize("dense,columns", [(0, 2048), (10 ** 9, 3), (100, 2)])
def test_matrix_products_count_as_single_items_do(spark, monkeypatch, dense, columns):
    """Items that go through matrix products (none, all, the common ones) give the same lists and intervals."""
    monkeypatch.setattr(knn, "_DENSE", dense)
    monkeypatch.setattr(knn, "_COLUMNS", columns)
    monkeypatch.setattr(knn, "_CHUNK", 8)
    rows = log(5)
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    got = {(r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in knn.top_k_users(df, 4, "cosine", 30).collect()}
    assert got == all_pairs(rows, 4, "cosine")
    born = [(u, i, (u + i) % 3) for u, i, _ in rows]
    spans = knn.count_intervals(spark.createDataFrame(born, "user_id bigint, item_id bigint, born int"), ("item_id",), 3, 30).collect()
    scores = {(v, s["user_id"], s["neighbor_id"]): s["score"] for s in spans for v in range(s["version"], s["until"] + 1)}
    want = {}
    for u, i, b in born:
        for v, j, c in born:
            for version in range(max(b, c), 3):
                if u < v and i == j:
                    want[version, u, v] = want.get((version, u, v), 0) + 1
    assert scores == want


@pytest.mark.parametrize("measure", ["cosine", "jaccard", "count"])
@pytest.mark.parametrize("sums", [3, 4_000_000])
def test_bounds_of_users_and_blocks(spark, monkeypatch, measure, sums):
    """Bounds as counted entry by entry; nothing as large as the entries is broadcast or joined entry by entry."""
    monkeypatch.setattr(knn, "_SUMS", sums)
    monkeypatch.setattr(knn, "PACK", 3)
    rows = log(6, communities=3)
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    entries, blocks = knn._layout(df, measure, 7, ["item_id"])
    bounds = knn._bounds(entries, measure, blocks)
    if measure != "jaccard":  # it broadcasts one number for each block
        assert "Broadcast" not in bounds._jdf.queryExecution().executedPlan().toString()
    held, size, block, tops = {}, {}, {}, {}
    for r in entries.collect():
        size[r["user_id"]], block[r["user_id"]] = r["size"], r["block"]
        held.setdefault(r["user_id"], {}).update(zip(r["items"], r["weights"] or [1.0] * len(r["items"])))
    unit = lambda u, w: w / size[u] if measure == "cosine" else 1.0
    for u, items in held.items():
        for i, w in items.items():
            tops.setdefault(i, {}).setdefault(block[u], []).append(unit(u, w))
    wanted = {}
    for u, items in held.items():
        for i, w in items.items():
            for b, values in tops[i].items():
                wanted[u, b] = wanted.get((u, b), 0.0) + unit(u, w) * max(values)
    if measure == "jaccard":
        least = {b: min(size[u] for u in block if block[u] == b) for b in block.values()}
        wanted = {(u, b): s / (size[u] + max(s, least[b]) - s) for (u, b), s in wanted.items()}
    got = {(r["user_id"], r["block"]): r["bound"] for r in bounds.collect()}
    assert blocks > 3 and got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(v + knn._HALF, abs=1e-9) for k, v in wanted.items())


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_lists_of_versions_leave_a_task_once(spark, monkeypatch, few):
    """What leaves the tasks is final: k rows for a user and version at most, however many blocks there are; versions counted pair by pair or as a whole."""
    monkeypatch.setattr(knn, "_FEW", few)
    monkeypatch.setattr(knn, "_COLUMNS", 5)
    rng = random.Random(9)
    rows = [(u, i, rng.choice([0, 0, 1, 2])) for u in range(120) for i in rng.sample(range(30), 18)] + [(u, 100 + u // 2, 1) for u in range(120)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, born int")
    info = {}
    got = knn.top_k_users(df, 3, "count", 10, versions=3, info=info).collect()
    want = counts_by_version(rows, 3, 3)
    assert {(r["version"], r["user_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in got} == want
    assert info["emitted"] == len(got) == len(want)


def test_changes_hold_both_counts(spark):
    rng = random.Random(10)
    rows = [(u, i, rng.choice([0, 0, 1])) for u, i, _ in log(3, users=40, communities=2)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, born int")
    got = {(r["user_id"], r["neighbor_id"]): (r["before"], r["after"]) for r in knn.count_changes(df, ("item_id",), 9).collect()}
    counts = counts_by_version(rows, 10 ** 6, 2)
    want = {}
    for (version, u, _), (v, c) in counts.items():
        if u < v:
            want.setdefault((u, v), [0, 0])[version] = c
    assert got == {k: tuple(v) for k, v in want.items()}


def test_a_pair_of_blocks_meets_once(spark):
    """All pairs: a user visits its own block and later ones only, and both directions are there."""
    rows = [(u, i, 1.0) for u in range(60) for i in range(u % 3, 9, 2)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, weight double")
    entries, blocks = knn._layout(df, "count", 10, ["item_id"])
    visits = knn._bounds(entries, "count", blocks).selectExpr("user_id", "block", "bound", "0.0D as kth")
    got = knn._visits(entries, visits, "count", None, 1, "products")
    items = {u: {i for v, i, _ in rows if v == u} for u in range(60)}
    assert sorted(tuple(r) for r in got.collect()) == sorted((u, v, float(len(items[u] & items[v]))) for u in items for v in items if u != v and items[u] & items[v])
    assert blocks == 6
