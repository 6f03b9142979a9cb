"""The pipeline against a plain version of every stage, and its stages on awkward rows."""

import cases
import corpus_pipeline
import numpy as np
import test_minhash
import test_mixing
import test_packing
import test_secrets
from pyspark.sql import functions as F

from seqrec.llm import mixing, queries, stages

SF = "/root/testdata/sf0.001"


def redacted(text):
    want, at = "", 0
    for start, _, kind, end in test_secrets.brute(text):
        if start >= at:
            want, at = want + text[at:start] + f"[{kind}]", end
    return want + text[at:]


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = test_minhash.brute(rows)
    rows = [(i, redacted(t)) for i, t in rows if first[i] == i]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = mixing.mix(docs, docs.join(queries.domain_labels(spark, SF), "doc_id"), queries.MIX, subset=True, calibrate=True)
    table = made["rates"].withColumn("chance", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)).orderBy("doc_id").collect()
    wanted = np.array([queries.MIX[d] for d in made["domains"]])
    rate = test_mixing.plain_subset(np.array([r["n_tokens"] for r in table], float), np.array([r["posterior"] for r in table]), wanted)
    assert np.allclose(rate, [r["rate"] for r in table], atol=1e-4)
    stay = {r["doc_id"] for r, x in zip(table, rate) if x > r["chance"]}
    assert 0.5 * len(rows) < len(stay) < len(rows)
    library = Tokenizer.from_file(queries.vocabulary())
    library.encode_special_tokens = True
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in rows if i in stay}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(i, len(x)) for i, x in want.items()}
    from zlib import crc32
    for r in got:
        piece = np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert crc32(piece.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))


def test_stages_keep_columns_and_clean_documents(spark):
    rows = [(i, t) for i, t in cases.awkward()] + [(100 + k, cases.prose(700 + k, 60)) for k in range(20)]
    docs = cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    clean = {100 + k for k in range(20)}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = [r["doc_id"] for r in out.collect()]
        assert clean <= set(kept) if name != "mixing" else len(set(kept)) >= 0.5 * len(rows), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert sum(r["length"] for r in stages.pack(spark, docs, SF).collect()) > 0


def test_language_rejects_only_texts_without_letters(spark):
    docs = cases.frame(spark, cases.awkward()).select("doc_id", "text", "lang", "source", "n_chars")
    kept = sorted(r["doc_id"] or 0 for r in stages.language(spark, docs, SF).collect())
    assert kept == sorted(i or 0 for i, t in cases.awkward() if any(c.isalpha() for c in t or ""))


def test_packed_pieces_of_a_stage(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.vocabulary())
    library.encode_special_tokens = True
    from seqrec.llm import packing
    documents = [(k, cases.prose(k, 100 + k)) for k in range(40)]
    test_packing.check(packing.pack(cases.frame(spark, documents), queries.vocabulary()).collect(), documents, library, 1024)
