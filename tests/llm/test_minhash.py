"""Near-duplicate classes against brute force over all pairs."""

import math
import random
from collections import Counter

import cases

from seqrec.llm import minhash


def brute(rows, threshold=0.8):
    """Classes by the weighted Jaccard similarity of all pairs, with document frequencies by word (small data: no shared buckets)."""
    held = Counter()
    for _, t in rows:
        held.update({cases.lower(w) for w in cases.words(t)})
    n = len(rows)
    idf = {w: math.sqrt(1 + math.log((1 + n) / (1 + c))) for w, c in held.items()}

    def bag(text):
        w = [cases.lower(x) for x in cases.words(text)]
        count = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        return {s: c * sum(idf[x] for x in s) / len(s) for s, c in count.items()}

    bags = [(i, bag(t)) for i, t in rows if i is not None]
    linked = []
    for k, (a, x) in enumerate(bags):
        for b, y in bags[k + 1:]:
            if x and y:
                both = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
                if both >= threshold * (sum(x.values()) + sum(y.values()) - both):
                    linked.append((a, b))
    return cases.classes({i for i, _ in bags}, linked)


def family(seed, copies, words, changes):
    rng = random.Random(seed)
    base = cases.prose(seed, words).split()
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def found(spark, rows, **options):
    df = minhash.near_duplicates(cases.frame(spark, rows).repartition(4), **options)["classes"]
    assert df.columns == ["doc_id", "class_id", "kept"]
    return df.collect()


def test_classes_equal_brute_force(spark):
    texts = [t for seed in range(6) for t in family(seed, 8, 120, 2)] + [cases.prose(100 + k, 80) for k in range(30)]
    passage = cases.prose(900, 60)
    texts += [passage + " " + cases.prose(200 + k, 60) for k in range(25)]  # share half their text, no duplicates
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    want = brute(rows)
    got = found(spark, rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_large_mixed_buckets_take_the_second_path(spark):
    """With a bucket limit of 2, members that the first comparison leaves apart go through the split by two bands."""
    texts = family(5, 30, 100, 3) + [cases.prose(300 + k, 70) for k in range(10)]
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in found(spark, rows, small=2, bands=40)}
    assert got == want


def test_awkward_rows(spark):
    rows = cases.awkward()
    got = found(spark, rows)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == 1 and by[7] == by[8] == 7
    assert by[4] == 4 and by[5] == 5 and by[6] == 6
    assert all(r["class_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert by[10] == 10 and by[12] == 12


def test_empty_table(spark):
    made = minhash.near_duplicates(cases.frame(spark, []))
    assert made["classes"].count() == 0 and made["links"].count() == 0
