"""Word spans, hashes and shingles against plain Python; components against union-find."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqrec.llm import textops as T
from seqrec.llm.graph import components

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b.ß ", max_size=30)), max_size=8)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    seen = {}
    got_rows = []
    for begin, data, offsets in T.text_chunks(pa.array(texts, pa.string()), limit):
        starts, ends, first = T.word_spans(data, offsets)
        hashes = T.span_hashes(T.LOWER[data], starts, ends)
        for k in range(len(offsets) - 1):
            own = [data[a:b].tobytes().decode() for a, b in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]])]
            got_rows.append(own)
            for word, h in zip(own, hashes[first[k]:first[k + 1]]):
                key = "".join(c.lower() if c.isascii() else c for c in word)
                assert seen.setdefault(key, h) == h
    assert got_rows == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 4))
def test_shingles(rows, width):
    first = np.cumsum([0, *map(len, rows)])
    hashes = T.mix(np.array([ord(c) for r in rows for c in r], np.uint64) + np.uint64(1))
    at, taken, row = T.shingles(hashes, first, width)
    value = T.shingle_hashes(hashes, at, taken, width)
    flat = [c for r in rows for c in r]
    got = [(int(r), "".join(flat[a:a + t])) for r, a, t in zip(row, at, taken)]
    assert got == [(k, "".join(r[i:i + width])) for k, r in enumerate(rows) for i in (range(max(1, len(r) - width + 1)) if r else ())]
    by = {}
    for (_, text), v in zip(got, value):
        assert by.setdefault(text, v) == v
    assert len(set(by.values())) == len(by)


def test_sliced_column_with_nulls():
    column = pa.array(["x y", None, "z", ""], pa.string()).slice(1, 3)
    (begin, data, offsets), = T.text_chunks(column)
    assert begin == 0 and offsets.tolist() == [0, 0, 1, 1] and data.tobytes() == b"z"


def naive(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(500, k) for k in range(400, 480)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links = chain + star + some + some[:20] + [(7, 7)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == naive(links)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
