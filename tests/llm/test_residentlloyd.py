"""Member-resident Lloyd against a plain version with Python integers."""

import hashlib
import math

import numpy as np
import pytest

from seqrec.llm import queries, residentlloyd

NAN, INF = float("nan"), float("inf")


def plain(rows, positions=4, entries=256, rounds=4, scale=1024):
    """{row index: (code, error)}, codebooks; rows are (vec_id, vector)."""
    good = [(k, i, [math.floor(scale * c) for c in v]) for k, (i, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    good.sort(key=lambda g: (g[1] is None, g[1] or 0, g[2]))
    wide = len(good[0][2]) // positions
    parts = [[g[2][p * wide:(p + 1) * wide] for g in good] for p in range(positions)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        for p in range(positions):
            at = [nearest(x, books[p])[0] for x in parts[p]]
            for e in set(at):
                mine = [x for x, a in zip(parts[p], at) if a == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = {}
    for k, g in enumerate(good):
        near = [nearest(parts[p][k], books[p]) for p in range(positions)]
        out.setdefault(g[1], []).append((tuple(e for e, _ in near), sum(d for _, d in near)))
    return out, books


def found(made):
    out = {}
    for r in made["codes"].collect():
        out.setdefault(r["vec_id"], []).append((tuple(r["code"]), r["error"]))
    return out


def same(got, want):
    return {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k % 3 if k % 4 else None, "x", 1) for k, (i, v) in enumerate(rows)],
                                 "vec_id bigint, embedding array<double>, label int, rid string, pos int").repartition(3)


@pytest.mark.parametrize("member_rows", [1 << 17, 16])
def test_equals_plain_lloyd(spark, member_rows):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 8)), np.repeat(rng.normal(size=(1, 8)), 80, 0), rng.normal(size=(60, 8)) * 0.01 + 3])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) * 3, x)]
    made = residentlloyd.compress(frame(spark, rows), entries=16, member_rows=member_rows)
    want, books = plain(rows, entries=16)
    assert same(found(made), want)
    assert [b.tolist() for b in made["codebooks"]] == books
    assert made["moved"] and all(0 < m < 4 * len(rows) for m in made["moved"])


def test_entries_that_fill_up_get_more_owners(spark):
    """All parts start at one entry of a codebook of near-equal entries and move to others round by round."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((6, 4), -1.0) + np.arange(6)[:, None] * 0.002, rng.normal(size=(400, 4)) + np.arange(400)[:, None] * 0.02])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = []
    real = residentlloyd._need
    residentlloyd._need = lambda *a: asked.append(real(*a)) or asked[-1]
    try:
        made = residentlloyd.compress(frame(spark, rows), entries=6, member_rows=8)
    finally:
        residentlloyd._need = real
    assert any(b[k] > a.get(k, 1) for a, b in zip(asked, asked[1:]) for k in b)  # owners were added on the way
    want, books = plain(rows, entries=6)
    assert same(found(made), want) and [b.tolist() for b in made["codebooks"]] == books


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    for size in (3e4, 1e6, 1e13):
        rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(40)]
        want, books = plain(rows, entries=8)
        made = residentlloyd.compress(frame(spark, rows), entries=8)
        got = found(made)
        assert [b.tolist() for b in made["codebooks"]] == books
        assert {i: v[0][0] for i, v in got.items()} == {i: v[0][0] for i, v in want.items()}
        assert {i: v[0][1] for i, v in got.items()} == {i: min(v[0][1], 2 ** 63 - 1) for i, v in want.items()}


def test_residents_are_read_by_owner_without_an_exchange(spark, capsys):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(100, 8)))]
    plans = []
    real = residentlloyd._Resident.__init__

    def seen(self, parts, buckets):
        parts.explain()
        plans.append(capsys.readouterr().out)
        real(self, parts, buckets)

    residentlloyd._Resident.__init__ = seen
    try:
        residentlloyd.compress(frame(spark, rows), entries=8)
    finally:
        residentlloyd._Resident.__init__ = real
    merges = [p for p in plans if "FlatMapCoGroupsInArrow" in p]
    assert merges
    for plan in merges:  # the only exchange by owner is that of the notes of parts that move
        residents = plan[plan.index("FlatMapCoGroupsInArrow"):]
        first = residents[:residents.index("FileScan")]
        assert "hashpartitioning" not in first and "Bucketed: true" in residents


def test_awkward_vectors(spark):
    rows = [(1, [0.5, -0.5, 0.25, 0.0]), (1, [0.5, -0.5, 0.25, 0.0]), (2, [-0.0001, 0.0, 0.0, 0.0]), (3, None), (4, []), (5, [NAN, 1.0, 1.0, 1.0]), (6, [1.0, INF, 0.0, 0.0]),
            (7, [None, 1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (None, [0.0, 0.0, 0.0, 1.0])]
    made = residentlloyd.compress(frame(spark, rows), keep=("label", "rid"))
    want, _ = plain([r for r in rows if r[0] != 8])
    assert same(found(made), want) and made["codes"].select("kept.rid").distinct().count() == 1
    empty = residentlloyd.compress(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert empty["codes"].count() == 0 and empty["codebooks"] == []
    assert residentlloyd.compress(frame(spark, [(1, None), (2, [])]))["codes"].count() == 0
    with pytest.raises(ValueError):
        residentlloyd.compress(frame(spark, [(1, [1.0] * 6)]))


def test_query_digest(spark, tmp_path):
    rows = [(i, [float((i * k) % 11) / 8 for k in range(1, 9)]) for i in range(50)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_resident_lloyd(spark, str(tmp_path)).collect()
    want, books = plain(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {i: ("".join(f"{e:02x}" for e in v[0][0]), v[0][1]) for i, v in want.items()}
    sums = {}
    for k, (i, _) in enumerate(rows):
        label = k % 3 if k % 4 else None
        sums[label] = sums.get(label, 0) + want[i][0][1]
    assert {r["vec_id"]: r["label_error"] for r in got} == {i: sums[k % 3 if k % 4 else None] for k, (i, _) in enumerate(rows)}
    digits = ",".join(str(c) for b in books for e in b for c in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(digits.encode()).hexdigest()}
