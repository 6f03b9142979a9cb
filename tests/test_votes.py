"""The vote sweep against counting again at every event."""

import random

import numpy as np
import pytest

from seqrec.operators import votes
from seqrec.operators.neighbors import pad_short_lists
from seqrec.session import cut


def counted(base, log, seen, later, events, n):
    out = []
    for e, o in enumerate(events):
        score = dict(enumerate(base))
        for place, when in log:
            score[place] += when < o
        gone = set(seen) | {p for p, first in later if first < o}
        best = sorted((-s, p) for p, s in score.items() if s > 0 and p not in gone)[:n]
        out += [(e, p, -s, r) for r, (s, p) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_sweep_equals_counting_again(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(votes, "_EVENTS", rng.choice([1, 3, 512]))
    items = rng.choice([1, 5, 40])
    base = [rng.choice([0, 0, 1, 2, 7]) for _ in range(items)]
    ords = sorted(rng.sample(range(100), rng.choice([1, 4, 20])))
    log = [(rng.randrange(items), rng.randrange(ords[0], ords[-1] + 1)) for _ in range(rng.choice([0, 3, 30]))]
    seen = rng.sample(range(items), rng.randrange(items))
    own = [(p, rng.randrange(110)) for p in rng.sample(range(items), rng.randrange(items)) if p not in seen]
    n = rng.choice([1, 3, 10])
    array = lambda values: np.array(values, dtype=np.int64)
    got = votes._swept(array(base), array([p for p, _ in log]), array([o for _, o in log]), array(seen), array([p for p, _ in own]), array([o for _, o in own]), array(ords), n)
    assert [tuple(map(int, row)) for row in got.T] == counted(base, log, seen, own, ords, n)


def test_requests_in_groups_equal_counting_again(spark, monkeypatch):
    monkeypatch.setattr(votes, "REQUESTS", 2)
    rng = random.Random(5)
    rows = [(u, rng.randrange(12), o, o >= 140) for o, u in enumerate(rng.choices(range(9), k=200))]
    lists = [(version, u, v) for version in (139, 170) for u in range(8) for v in rng.sample([x for x in range(9) if x != u], 3)]
    scored = [(o, u, o, 139 if o <= 170 else 170, 139 if o <= 150 else 150 if o <= 170 else 170) for u, _, o, test in rows if test and u < 8]
    ev = spark.createDataFrame(rows, "user_id bigint, item_id bigint, ord bigint, is_test boolean")
    got = votes.sweep_votes(ev, spark.createDataFrame(lists, "list bigint, user_id bigint, neighbor_id bigint"),
                            spark.createDataFrame(scored, "event_id bigint, user_id bigint, ord bigint, list bigint, window bigint"), 4).collect()
    want = set()
    for event, u, o, version, _ in scored:
        held = {i for v, i, at, _ in rows if v == u and at < o}
        score = {}
        for _, _, v in [x for x in lists if x[0] == version and x[1] == u]:
            for w, i, at, _ in rows:
                if w == v and at < o and i not in held:
                    score[i] = score.get(i, 0) + 1
        want |= {(event, u, i, s, r) for r, (s, i) in enumerate(((s, i) for s, i in sorted(((s, i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:4]), 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_lists_and_profiles_are_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, name="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(votes, "cut", kept)
    ev = spark.createDataFrame([(u, i, 10 * u + i, i > 2) for u in range(4) for i in range(5)], "user_id bigint, item_id bigint, ord bigint, is_test boolean")
    lists = spark.createDataFrame([(0, u, v) for u in range(4) for v in range(4) if u != v], "list bigint, user_id bigint, neighbor_id bigint")
    scored = spark.createDataFrame([(10 * u + i, u, 10 * u + i, 0, 0) for u in range(4) for i in (3, 4)], "event_id bigint, user_id bigint, ord bigint, list bigint, window bigint")
    out = votes.sweep_votes(ev, lists, scored, 3)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)


def test_padding_broadcasts_no_lists(spark):
    net = cut(spark.createDataFrame([(1, 2, 5, 1), (2, 1, 5, 1), (2, 3, 4, 2)], "user_id bigint, neighbor_id bigint, score bigint, rank bigint"))
    ids = spark.createDataFrame([(u,) for u in (1, 2, 3, 4)], "user_id bigint")
    padded = pad_short_lists(net, ids, 2)
    plan = padded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in padded.collect()) == [(1, 2, 5, 1), (1, 3, 0, 2), (2, 1, 5, 1), (2, 3, 4, 2), (3, 1, 0, 1), (3, 2, 0, 2), (4, 1, 0, 1), (4, 2, 0, 2)]
