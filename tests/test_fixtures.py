"""Golden micro fixtures (FIXTURES.md §2), worked by hand from the semantics."""

from collections import defaultdict

import pytest
from conftest import F1_ROWS, ratings_df
from pyspark.sql import functions as F

from seqrec.operators import blocks as B
from seqrec.operators import evaluate as EV
from seqrec.operators import ordering as O
from seqrec.operators import recommend as R
from seqrec.operators import similarity as S
from seqrec.operators import sessions as SE
from seqrec.operators import splits as SP
from seqrec.operators import topk as T
from seqrec.operators.neighbors import topk_user_neighbors
from seqrec.plans.user_based import UserBasedParams, user_based


def _train_test(f1):
    split = SP.holdout_last_n(f1, n=4)
    return SP.train_part(split).drop("is_test"), SP.test_part(split).drop("is_test")


def test_split_last_four(f1):
    train, test = _train_test(f1)
    assert train.count() == 12
    assert sorted(r.event_id for r in test.collect()) == [12, 13, 14, 15]


def test_consumption_blocks(f1):
    train, _ = _train_test(f1)
    rows = B.consumption_blocks(train, 10).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.user_id, r.block_id, r.n)):
        got[(r.user_id, r.block_id)].append(r.item_id)
    assert dict(got) == {(1, 0): [10, 11, 12], (2, 0): [10, 12, 11], (3, 0): [12, 10]}


def test_block_item_similarity(f1):
    train, _ = _train_test(f1)
    sim = {(r.src_item, r.dst_item): r.score for r in S.block_item_similarity(train, 10).collect()}
    assert sim == {(10, 11): 7.0, (10, 12): 7.0, (11, 12): 2.0, (12, 10): 4.0, (12, 11): 6.0}


def test_block_similarity_tiled_equals_plain(f1):
    train, _ = _train_test(f1)
    plain = {tuple(r) for r in S.block_item_similarity(train, 10).collect()}
    tiled = {tuple(r) for r in S.block_item_similarity(train, 10, tile_rows=1).collect()}
    assert plain == tiled


def test_topk_item_neighbors(f1):
    train, _ = _train_test(f1)
    net = T.topk_neighbors(S.block_item_similarity(train, 10), 30, src="src_item", dst="dst_item").collect()
    got = defaultdict(list)
    for r in sorted(net, key=lambda r: (r.src_item, r.rank)):
        got[r.src_item].append(r.dst_item)
    assert dict(got) == {10: [11, 12], 11: [12], 12: [11, 10]}


@pytest.mark.parametrize("delta,expected", [(2, (1, 1, 1)), (3, (5, 3, 3)), (40, (6, 3, 3))])
def test_seq_user_similarity(f1, delta, expected):
    train, _ = _train_test(f1)
    sim = {(r.user_a, r.user_b): r.score for r in S.seq_user_similarity(O.order_events(train), delta).collect()}
    assert (sim[(1, 2)], sim[(1, 3)], sim[(2, 3)]) == expected
    assert sim[(2, 1)] == sim[(1, 2)]


def test_topk_user_neighbors_padded(f1):
    train, _ = _train_test(f1)
    tr = O.order_events(train)
    net = topk_user_neighbors(S.seq_user_similarity(tr, 40), 2, users=tr).collect()
    got = defaultdict(list)
    for r in sorted(net, key=lambda r: (r.user_id, r.rank)):
        got[r.user_id].append(r.neighbor_id)
    assert dict(got) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def test_recommend_user_neighbors_and_metrics(f1):
    out = user_based(f1, UserBasedParams(delta=40, k=2, n=10, test_n=4, every=10**9))
    per_event = defaultdict(dict)
    for r in out["recs"].collect():
        per_event[r.event_id][r.item_id] = r.score
    assert dict(per_event) == {13: {14: 1}, 14: {13: 2, 14: 2}}
    m = out["metrics"].collect()[0]
    assert (m.precision, m.recall, m.users) == (0.75, 1.0, 2)


def test_recommend_item_neighbors_empty(f1):
    train, test = _train_test(f1)
    net = T.topk_neighbors(S.block_item_similarity(train, 10), 30, src="src_item", dst="dst_item") \
        .withColumnRenamed("src_item", "src").withColumnRenamed("dst_item", "dst")
    recs = R.recommend_item_neighbors(train, test, net, 3)
    assert recs.count() == 0
    truth = test.join(train.select("user_id"), "user_id", "left_semi")
    m = EV.precision_recall(recs, truth, population=test).collect()[0]
    assert m.precision is None and m.recall is None and m.norec == 3


def test_user_sessions(spark):
    df = ratings_df(spark, F1_ROWS, shift=1_000_000_000)
    rows = SE.user_sessions(df, 86400, 3).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.user_id, r.session_id, r.n)):
        got[(r.user_id, r.session_id)].append(r.item_id)
    assert dict(got) == {(1, 0): [10], (1, 1): [11, 12, 13, 14], (1, 2): [15],
                         (2, 0): [10, 12, 11, 13], (2, 1): [14], (3, 0): [12, 10, 11], (3, 1): [13]}


def test_pseudo_ratings_f3(spark):
    from seqrec.operators.decay import pseudo_ratings
    day = 86400
    t0 = 1000 * day
    # (item age, purchase age) in days -> weight
    cases = [(0, 0, 5.0), (200, 10, 4.2), (45, 31, 3.8), (150, 150, 0.2), (95, 61, 2.4)]
    rows = []
    for k, (ia, pa, _) in enumerate(cases):
        item = 100 + k
        rows.append((k, item, 3.0, t0 - ia * day, 2 * k))          # launch event of the item
        rows.append((50 + k, item, 3.0, t0 - pa * day, 2 * k + 1))  # the purchase we weigh
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, ts bigint, event_id bigint")
    w = {r.item_id: r.weight for r in pseudo_ratings(df, F.lit(t0), day, 30).collect() if r.user_id >= 50}
    assert w == {100 + k: c[2] for k, c in enumerate(cases)}


def test_candidate_widening_f4(spark):
    from seqrec.operators.vectors import candidate_vocab_size
    df = spark.createDataFrame([([70, 80],), ([59, 200],), ([],)], "r array<bigint>")
    got = [r.R for r in df.select(candidate_vocab_size(F.col("r"), F.lit(1000)).alias("R")).collect()]
    assert got == [60, 70, 60]
    small = [r.R for r in df.select(candidate_vocab_size(F.col("r"), F.lit(40)).alias("R")).collect()]
    assert small == [40, 40, 40]


def test_precision_recall_f2(spark):
    recs = spark.createDataFrame([(1, 12), (1, 13)], "user_id bigint, item_id bigint")
    truth = spark.createDataFrame([(1, 12), (1, 15)], "user_id bigint, item_id bigint")
    m = EV.precision_recall(recs, truth).collect()[0]
    assert (m.precision, m.recall) == (0.5, 0.5)
    listed = spark.createDataFrame([(1, 12), (1, 13), (1, 12), (1, 13)], "user_id bigint, item_id bigint")
    mm = EV.precision_recall_multiset(listed, truth).collect()[0]
    assert (mm.precision, mm.recall) == (0.25, 0.5)
