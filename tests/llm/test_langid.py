"""Language profiles: held-out accuracy on the documents table, and awkward rows."""

import cases
import numpy as np
import pyarrow as pa

from seqrec.llm import langid, queries
from seqrec.llm import textops as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op6_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 250 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def naive(text):
    codes = langid._letters()
    row = [0]
    for c in text:
        code = int(codes[ord(c)])
        if code or row[-1]:
            row.append(code)
    row += [0, 0]
    return [row[k - 1] * 4096 + row[k] * 64 + row[k + 1] for k in range(1, len(row) - 1) if row[k]]


def test_trigrams_equal_a_plain_loop():
    texts = ["", "a", " a1b--c ", "Éa é日本", None, "...", "the cat", "x\ny"]
    for limit in (1, 5, 1000):
        got = []
        for begin, data, offsets in T.text_chunks(pa.array(texts, pa.string()), limit):
            code, row = langid.trigrams(data, offsets)
            got += [code[row == k].tolist() for k in range(len(offsets) - 1)]
        assert got == [naive(t or "") for t in texts]


def test_vectors_are_bound_and_bundled():
    v = langid._bound(np.arange(langid.CODES**3)[::997], 256, 1).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    near = v @ v.T / 256
    np.fill_diagonal(near, 0)
    assert np.abs(near).max() < 0.6


def test_awkward_rows(spark):
    rows = cases.awkward()
    docs = cases.frame(spark, rows)
    got = langid.predict(docs, langid.fit(docs.where("doc_id < 8"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    none = langid.fit(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.predict(docs.where("false"), none).count() == 0
