"""Class language model: exact counts against Python, the score against a plain reading of the model, and held-out gain."""

import math
import random
from collections import Counter

import cases
import numpy as np
import pyarrow as pa

from seqrec.llm import classlm
from seqrec.llm import textops as T


def tokens(text):
    return [cases.lower(w) for w in cases.words(text)] + [None]


def hashed(token):
    if token is None:
        return int(classlm.END)
    (_, data, offsets), = T.text_chunks(pa.array([token]))
    return int(T.span_hashes(data, *T.word_spans(data, offsets)[:2])[0])


def grammar(rng, n):
    """Sentences of alternating word kinds, in two vocabularies."""
    side = rng.choice("xy")
    return " ".join(f"{side}{'abc'[k % 3]}{rng.randrange(30)}" for k in range(n))


def make(spark, train, docs, units=40, **options):
    model = classlm.fit(cases.frame(spark, train).repartition(3), units=units, buckets=8, classes=6, **options)
    return model, classlm.score(cases.frame(spark, docs), model).collect()


def check_base(train, docs, got):
    count = Counter(t for _, text in train for t in tokens(text))
    n, v = sum(count.values()), len(count)
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in docs)
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [x[:4] for x in want] == [x[:4] for x in have]
    assert np.allclose([x[4] for x in want], [x[4] for x in have], rtol=1e-9)
    return count


def plain_score(model, text, count):
    """The model's log probability, token by token."""
    held = {int(w): (int(n), int(u)) for w, n, u in zip(model.held_words, model.held_counts, model.held_units)}
    out, before = 0.0, model.unit_class[-1]
    for t in tokens(text):
        h = hashed(t)
        if h in held:
            unit = held[h][1]
        elif t is None:
            unit = model.units + model.buckets
        else:
            (_, data, offsets), = T.text_chunks(pa.array([t]))
            unit = model.units + int(T.span_hashes(data, np.array([max(0, len(data) - 3)]), np.array([len(data)]))[0] % np.uint64(model.buckets))
        k = model.unit_class[unit]
        out += model.log_next[before, k] + math.log10(count[t] + 1) - model.log_size[k]
        before = k
    return out


def test_counts_and_scores(spark):
    rng = random.Random(2)
    train = [(k, grammar(rng, rng.randrange(5, 40))) for k in range(200)] + [(900, None), (901, "")] + cases.awkward()
    docs = train[:20] + [(950, "never seen Words here"), (951, None)] + cases.awkward()
    for held in (1 << 18, 12):  # with 12 almost every word goes through the join
        model, got = make(spark, train, docs, held=held)
        assert len(model.held_words) <= held
        count = check_base(train, docs, got)
        by = {}
        for r in got:
            by.setdefault((r["doc_id"], r["n_tokens"]), r["score"])
        for i, t in docs:
            assert math.isclose(by[i, len(tokens(t))], plain_score(model, t, count), rel_tol=1e-9)
        assert np.allclose((10 ** model.log_next).sum(1), 1)


def test_gain_on_held_out_text(spark):
    rng = random.Random(5)
    train = [(k, grammar(rng, 60)) for k in range(400)]
    _, got = make(spark, train, [(k, grammar(rng, 60)) for k in range(40)], units=200)
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)
    assert all(r["perplexity"] > 1 for r in got)


def test_exchange_raises_the_likelihood_and_finds_kinds():
    rng = np.random.default_rng(1)
    kind = np.arange(30) % 3
    pairs = np.zeros((30, 30))
    for _ in range(4000):
        u = rng.integers(30)
        v = rng.choice(np.flatnonzero(kind == (kind[u] + 1) % 3))
        pairs[u, v] += 1
    own = classlm.exchange(pairs, 3, 20)
    assert all(len(set(own[kind == k])) == 1 for k in range(3)) and len(set(own)) == 3


def test_every_repeated_word_is_clustered(spark):
    """Endings tell nothing of a word's kind here, and almost no word is among the units of the start."""
    rng = random.Random(11)
    kinds = [[f"w{kind}x{k:03d}" for k in range(100)] for kind in "abc"]
    text = lambda n: " ".join(rng.choice(kinds[k % 3]) for k in range(n))
    train = [(k, text(60)) for k in range(400)] + [(900, "onlyonce")]
    docs = [(k, text(60)) for k in range(40)]
    model, got = make(spark, train, docs, units=30)
    count = check_base(train, docs, got)
    assert model.units == sum(n > 1 for t, n in count.items() if t is not None)
    held = dict(zip(map(int, model.held_words), model.unit_class[model.held_units]))
    for kind in kinds:
        of = Counter(held[hashed(w)] for w in kind)
        assert sum(n for _, n in of.most_common(2)) >= 95
    alone = make(spark, train, docs, units=30, passes=0)[1]
    assert sum(r["score"] for r in got) > 0.9 * sum(r["score"] for r in alone)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all(math.isclose(by[i], plain_score(model, t, count), rel_tol=1e-9) for i, t in docs)


def test_neighbour_counts_equal_brute_force(spark):
    rng = random.Random(4)
    train = [(k, grammar(rng, rng.randrange(3, 30))) for k in range(60)] + [(900, None), (901, "")]
    text = cases.frame(spark, train).select("text").repartition(3)
    vocab = sorted({hashed(t) for _, x in train for t in tokens(x) if t is not None})
    words, buckets, classes = np.array(vocab[::2], np.uint64), 8, 5
    own = np.array([k % classes for k in range(len(words) + buckets)], np.int16)
    sc = spark.sparkContext
    edges = np.unique(np.linspace(0, len(own), 8).astype(np.int64))
    rows = text.mapInArrow(classlm._neighbour_counts(sc.broadcast(words), sc.broadcast(own), buckets, classes, edges), "part int, keys binary, n binary")
    got = Counter()
    for r in rows.groupBy("part").applyInArrow(classlm._merged, "part int, keys binary, n binary").collect():
        keys, n = classlm._read(r["keys"], r["n"])
        assert all(edges[r["part"]] <= k // (2 * classes + 2) < edges[r["part"] + 1] for k in keys)
        got.update(dict(zip(keys.tolist(), n.tolist())))
    at = {int(w): k for k, w in enumerate(words)}

    def item(t):
        (_, data, _), = T.text_chunks(pa.array([t]))
        return at.get(hashed(t), len(words) + int(T.span_hashes(data, np.array([max(0, len(data) - 3)]), np.array([len(data)]))[0] % np.uint64(buckets)))

    want = Counter()
    for _, x in train:
        line = [None if t is None else item(t) for t in tokens(x)]
        for k, i in enumerate(line[:-1]):
            klass = [classes if j is None else int(own[j]) for j in (line[k + 1], line[k - 1] if k else None)]
            want[i * 2 * (classes + 1) + klass[0]] += 1
            want[(i * 2 + 1) * (classes + 1) + klass[1]] += 1
    assert got == want


def test_nothing_to_learn_from(spark):
    model, got = make(spark, [], [(1, "a b"), (2, None)])
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isclose(r["base_score"], 0.0, abs_tol=1e-12) for r in got)
    assert classlm.score(cases.frame(spark, []), model).count() == 0
