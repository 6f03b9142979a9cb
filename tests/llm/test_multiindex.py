"""Vector links against the full matrix."""

import os

import cases
import numpy as np
import pytest

from seqrec.llm import multiindex, queries


def brute(ids, x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    return dict(zip(ids, hit.sum(1))), cases.classes(ids, [(ids[i], ids[j]) for i, j in zip(a, b)])


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    near = x[:120] + rng.normal(size=(120, 16)) * 0.1
    group = x[5] + rng.normal(size=(60, 16)) * 0.12
    x = np.concatenate([x, near, group, x[:10], 3 * x[20:25]])
    ids = list(range(len(x)))
    rng.shuffle(ids)
    links, parts = brute(ids, x)
    df = spark.createDataFrame([(i, v.tolist(), 1, 7) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, copies int, cell int").repartition(3)
    got = multiindex.near_vectors(df, target_recall=1.0).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links and sum(links.values()) > 1000
    assert {r["vec_id"]: r["component_id"] for r in got} == parts
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_s"), reason="needs a table with planted links")
def test_default_recall_on_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").where("vec_id < 3000")
    rows = df.collect()
    links, parts = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float))
    got = multiindex.near_vectors(df).collect()
    assert sum(r["n_links"] for r in got) >= 0.999 * sum(links.values()) > 0
    assert sum(parts[r["vec_id"]] == r["component_id"] for r in got) >= 0.999 * len(rows)


def test_recall_below_one_keeps_most_links(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.08])
    links, _ = brute(list(range(len(x))), x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in multiindex.near_vectors(df, target_recall=0.9).collect()}
    assert all(got[i] <= n for i, n in links.items()) and sum(got.values()) >= 0.85 * sum(links.values())


def test_registered_query_loses_no_link_of_unlike_directions(spark, tmp_path, monkeypatch):
    """Partners that differ along the data's main directions, where the codewords lie too."""
    rng = np.random.default_rng(1)
    spread = np.arange(1, 65) ** -0.75
    x = rng.normal(size=(6000, 64)) * spread
    u = x[:60] / np.linalg.norm(x[:60], axis=1, keepdims=True)
    away = rng.normal(size=u.shape) * spread
    away -= (away * u).sum(1, keepdims=True) * u
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([x, 0.952 * u + np.sqrt(1 - 0.952 ** 2) * away])
    links, parts = brute(list(range(len(x))), x)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bounds, of = [], multiindex._bound
    monkeypatch.setattr(multiindex, "_bound", lambda *a: bounds.append(of(*a)) or bounds[-1])
    got = queries.op2_multi_index(spark, str(tmp_path)).collect()
    assert len(bounds) == 1 and bounds[0] >= 2 * (1 - 0.95)  # no link lies beyond
    assert {r["vec_id"]: r["n_links"] for r in got} == links and sum(links.values()) >= 120
    assert {r["vec_id"]: r["component_id"] for r in got} == parts


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1e-200, 1e200])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rid string")
    got = multiindex.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert by[1] == [(2, 1)] and by[2] == [(2, 1), (2, 1)]
    assert by[10] == [(1, 10)] and by[11] == [(1, 10)]
    assert all(by[k] == [(0, k)] for k in (3, 4, 5, 6, 7, 8, 9)) and by[None] == [(0, None)]


def test_empty_table(spark):
    assert multiindex.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_a_vector_is_sent_to_a_page_once(spark, monkeypatch):
    """Vectors go out once for each page of cells, not for each cell that they visit; pages of several blocks too."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(300, 8)), np.zeros((60, 8)) + rng.normal(size=8)]) + rng.normal(size=(360, 8)) * 0.05
    ids = list(range(len(x)))
    links, parts = brute(ids, x, 0.9)
    made, cut = {}, multiindex.cut

    def kept(df, name="cut"):
        made[name] = cut(df, name)
        return made[name]

    monkeypatch.setattr(multiindex, "cut", kept)
    monkeypatch.setattr(multiindex, "MEMBERS", 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got = multiindex.near_vectors(df, cosine=0.9, per_cell=4, target_recall=1.0).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == parts
    sent = made["visits"].selectExpr("count(*) rows", "count(distinct rid, page) pairs", "sum(size(cells)) cells").first()
    assert sent["rows"] == sent["pairs"] and 2 * sent["rows"] < sent["cells"]
    assert made["blocks"].where("m_blocks > 1").count() > 0
