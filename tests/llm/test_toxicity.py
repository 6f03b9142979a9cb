"""Toxicity: features against plain Python, held-out accuracy on planted words, awkward rows."""

import random

import cases
import numpy as np
import pyarrow as pa

from seqrec.llm import textops as T
from seqrec.llm import toxicity


def planted(rng, n):
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        w = cases.prose(10_000 + k, rng.randrange(20, 80)).split()
        if toxic:
            for _ in range(max(2, len(w) // 12)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorgblat", "zorgbnik", "you 1d1ot", "STUPID!!"]))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_learned_on_some_rows_and_right_on_others(spark):
    rows = planted(random.Random(1), 500)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(df.where("doc_id % 5 <> 0"), rounds=8)
    assert "zorgb*" in model.lexicon
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("score", df["label"] * 7), model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_features_of_small_texts():
    terms, stems, second = toxicity._hashes(["idiot"]), toxicity._hashes(["zorgb"]), toxicity._hashes(["you"])
    texts = ["You idiot!! now", "1d1ot and i.d.i.o.t here", "zorgblat ZORGBNIK calm", "", None, "... !!", "a you", "idiot a b c d you"]
    (_, data, offsets), = T.text_chunks(pa.array(texts))
    got = [dict(zip(toxicity.FEATURES, r)) for r in toxicity.features(data, offsets, terms, stems, second)]
    assert np.isclose(got[0]["lexicon_density"], 1 / 3) and got[0]["near_second_person"] > 0 and got[0]["exclamations"] > 0 and got[0]["repeated_marks"] > 0
    assert got[1]["lexicon_words"] == np.log1p(2) and got[1]["hidden_density"] > 0 and got[1]["mixed_words"] > 0
    assert got[2]["stem_words"] == np.log1p(2) and got[2]["capital_words"] > 0 and got[2]["lexicon_words"] == 0
    assert all(v == 0 for v in got[3].values()) and all(v == 0 for v in got[4].values())
    assert got[6]["near_second_person"] == 0 and got[7]["near_second_person"] == 0


def test_awkward_rows(spark):
    docs = cases.frame(spark, cases.awkward())
    one = toxicity.fit(docs.where("label = 1"))  # a single class
    assert one.trees is None and toxicity.score(docs, one).count() == docs.count()
    model = toxicity.fit(docs, rounds=2)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs.where("false"))
    assert none.base == 0.5 and toxicity.score(docs.where("false"), none).count() == 0
