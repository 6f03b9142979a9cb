"""Skip-gram with negative sampling on blocks: objective, independence of partitions, training further."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.operators import embeddings as EM
from seqrec.session import scratch_path

EM_cut = EM.cut


def sentences(seed, n=300, topics=4, words=8):
    rng = random.Random(seed)
    return [[f"{rng.randrange(topics) if rng.random() < 0.05 else t}_{rng.randrange(words)}" for _ in range(rng.randrange(1, 12))] for t in (rng.randrange(topics) for _ in range(n))]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(r,) for r in rows], "tokens array<string>").repartition(parts)


def loss(model, pairs, negatives):
    """The objective, with the exact expectation over the noise distribution, for each pair."""
    rows = {r["word"]: r for r in model.collect() if r["center"] is not None}
    names = sorted(rows)
    u, v = np.array([rows[w]["center"] for w in names]), np.array([rows[w]["context"] for w in names])
    noise = np.array([rows[w]["n"] for w in names]) ** 0.75
    noise /= noise.sum()
    count = np.zeros((len(names), len(names)))
    for r in pairs:
        count[names.index(r["center"]), names.index(r["context"])] = r["n"]
    s = u @ v.T
    low = lambda x: -np.logaddexp(0, -x)
    return -((count * low(s)).sum() + negatives * (count.sum(1)[:, None] * noise * low(-s)).sum()) / count.sum()


def plain(pairs, counts, p):
    """Plain sequential training in one block with numpy: each pair with its own negatives, the same steps."""
    names = sorted(counts)
    rng = np.random.default_rng(1)
    at = {w: k for k, w in enumerate(names)}
    u, v = ((rng.random((len(names), p.size)) - 0.5) / p.size), np.zeros((len(names), p.size))
    gu, gv = np.zeros(len(names)), np.zeros(len(names))
    noise = np.array([counts[w] for w in names]) ** 0.75
    noise /= noise.sum()
    each = [(at[r["center"]], at[r["context"]]) for r in pairs for _ in range(r["n"])]
    for _ in range(p.epochs):
        for k in rng.permutation(len(each)):
            c, o = each[k]
            for target, label in [(o, 1.0), *[(t, 0.0) for t in rng.choice(len(names), p.negatives, p=noise)]]:
                g = label - 1 / (1 + np.exp(-u[c] @ v[target]))
                du, dv = g * v[target], g * u[c]
                gu[c] += (du * du).mean()
                gv[target] += (dv * dv).mean()
                u[c] += p.rate * du / np.sqrt(gu[c] + 1e-10)
                v[target] += p.rate * dv / np.sqrt(gv[target] + 1e-10)
    return {w: (u[k], v[k]) for w, k in at.items()}


P = EM.SkipGram(size=12, window=3, negatives=4, epochs=4, seed=7, batch=16)


def test_pairs_equal_a_plain_count(spark):
    rows = sentences(1, 40)
    got = {(r["center"], r["context"]): r["n"] for r in EM.skip_pairs(frame(spark, rows), 1, 3).collect()}
    want = {}
    for s in rows:
        for a, b in zip(s, s[1:]):
            want[a, b] = want.get((a, b), 0) + 1
            want[b, a] = want.get((b, a), 0) + 1
    assert got == want
    wide = EM.skip_pairs(frame(spark, rows), 3, 3).agg(F.sum("n")).first()[0]
    most = sum(min(i + 3, len(s) - 1) - max(i - 3, 0) for s in rows for i in range(len(s)))
    assert sum(got.values()) < wide < most


def test_alias_tables_draw_in_proportion():
    weights = np.array([5.0, 0.0, 1.0, 3.0, 1.0])
    drawn = EM._drawn(EM._alias(weights), 100_000, np.random.default_rng(0))
    assert np.abs(np.bincount(drawn, minlength=5) / 1e5 - weights / 10).max() < 0.01


@pytest.mark.parametrize("blocks", [1, 4])
def test_loss_as_low_as_plain_training(spark, blocks):
    rows = sentences(2)
    corpus = frame(spark, rows)
    p = EM.SkipGram(**{**P.__dict__, "block_words": 1000 if blocks == 1 else 8})
    model = EM.train_skip_gram(corpus, p)
    pairs = EM.skip_pairs(corpus, p.window, p.seed).collect()
    counts = {r["word"]: r["n"] for r in model.collect()}
    vectors = plain(pairs, counts, p)
    as_model = spark.createDataFrame([(w, counts[w], u.tolist(), 0.0, v.tolist(), 0.0) for w, (u, v) in vectors.items()], EM.MODEL)
    untrained = spark.createDataFrame([(w, counts[w], u.tolist(), 0.0, [0.0] * p.size, 0.0) for w, (u, v) in vectors.items()], EM.MODEL)
    mine, theirs, start = (loss(m, pairs, p.negatives) for m in (model, as_model, untrained))
    assert mine <= 1.05 * theirs and theirs < 0.9 * start  # the bound that blocks may cost
    unit = {w: np.array(r["center"]) / np.linalg.norm(r["center"]) for r in model.collect() for w in [r["word"]]}
    same = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a != b and a[0] == b[0]])
    apart = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a[0] != b[0]])
    assert same > apart + 0.3


def test_result_does_not_depend_on_partitions(spark):
    rows = sentences(3, 60)
    p = EM.SkipGram(**{**P.__dict__, "epochs": 1, "block_words": 10})
    results = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 2))
        results.append({r["word"]: tuple(r) for r in EM.train_skip_gram(frame(spark, rows, parts), p).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_cells_of_a_round_are_tasks_of_their_own(spark, monkeypatch):
    """However few bytes they are: every cell leaves a file of its own."""
    states = []

    def cut(df, name="cut"):
        out = EM_cut(df, name)
        if name == "sgns-state":
            states.append(out)
        return out

    monkeypatch.setattr(EM, "cut", cut)
    EM.train_skip_gram(frame(spark, sentences(3)), EM.SkipGram(**{**P.__dict__, "epochs": 1, "block_words": 10}))
    files = states[-1].where(~F.col("is_context")).select("block", F.input_file_name().alias("file")).distinct().collect()
    blocks = len({r["block"] for r in files})
    assert len(states) == blocks + 1 > 3
    assert len(files) == len({r["file"] for r in files}) == blocks


def test_training_further_beats_a_refit(spark):
    """A model of one batch, extended by another: known words keep what they learned, new ones come in, at the loss of a refit with the second batch's steps alone."""
    first, second = sentences(4, 300), sentences(5, 120) + [["new_1", "new_2", "0_1", "new_1"]] * 10
    path = scratch_path(spark, "model")
    assert EM.extend_model(frame(spark, first), path, P) == 0
    before = {r["word"]: r for r in EM.load_model(spark, path).collect()}
    one = EM.SkipGram(**{**P.__dict__, "epochs": 1})
    assert EM.extend_model(frame(spark, second), path, one) == 1 and EM.latest_version(spark, path) == 1
    after = {r["word"]: r for r in EM.load_model(spark, path).collect()}
    assert set(before) < set(after) and {"new_1", "new_2"} <= set(after)
    tokens = [w for s in first + second for w in s]
    assert all(after[w]["n"] == tokens.count(w) for w in after)
    assert {r["word"]: r["n"] for r in EM.load_model(spark, path, 0).collect()} == {w: r["n"] for w, r in before.items()}  # earlier versions stay
    every = frame(spark, first + second)
    pairs = EM.skip_pairs(every, P.window, P.seed).collect()
    warm, cold = EM.load_model(spark, path), EM.train_skip_gram(every, one)  # the refit passes over both batches, the extension over the second
    assert loss(warm, pairs, P.negatives) <= loss(cold, pairs, P.negatives)


def test_rare_words_wait_and_empty_batches_change_nothing(spark):
    p = EM.SkipGram(size=4, min_count=2, epochs=1, batch=4)
    model = EM.train_skip_gram(frame(spark, [["1", "2", "1", "2", "3"]]), p)
    got = {r["word"]: r for r in model.collect()}
    assert got["3"]["center"] is None and got["3"]["n"] == 1 and got["1"]["center"] is not None
    assert {r["item_id"] for r in EM.item_vectors(model).collect()} == {1, 2}
    again = {r["word"]: r for r in EM.train_skip_gram(frame(spark, [["3", "1"]]), p, model).collect()}
    assert again["3"]["center"] is not None and again["3"]["n"] == 2
    same = {r["word"]: tuple(r) for r in EM.train_skip_gram(spark.createDataFrame([], "tokens array<string>"), p, model).collect()}
    assert same == {w: tuple(r) for w, r in got.items()}
    assert EM.train_skip_gram(spark.createDataFrame([], "tokens array<string>"), p).count() == 0
