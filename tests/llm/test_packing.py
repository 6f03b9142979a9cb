"""Packing: ids against the tokenizers library, and exact round trips."""

import cases
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqrec.llm import packing, queries
from seqrec.llm import textops as T

SPACES = " \n\t\r\x0b\x0c  \x85　 \x1f"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.vocabulary())
    lib.encode_special_tokens = True
    return lib


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=SPACES + "ab'sré1.,!日“”\U0001f600", max_size=25), max_size=6), limit=st.integers(1, 60))
def test_ids_equal_the_library(library, texts, limit):
    own = packing.Tokenizer(queries.vocabulary(), most=20)
    got = []
    for _, data, offsets in T.text_chunks(pa.array(texts, pa.string()), limit):
        ids, edges = own.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_whole_documents(library, spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["<|endoftext|> a <|endoftext|>"]
    own = packing.Tokenizer(queries.vocabulary())
    got = []
    for _, data, offsets in T.text_chunks(pa.array(texts)):
        ids, edges = own.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, documents, library, size):
    """Every id of every document in one piece; sequences gapless, of the full size or a power of two."""
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in documents)
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    if len({i for i, _ in documents}) == len(documents):
        got = []
        for (_, whole), parts in pieces.items():
            ids = []
            for start, piece in sorted(parts):
                assert start == len(ids)
                ids += piece
            assert len(ids) == whole
            got.append(tuple(ids))
        assert sorted(got) == want
    assert sum(r["length"] for r in rows) == sum(map(len, want))


@pytest.mark.parametrize("partitions, size", [(1, 64), (7, 64), (20, 1024)])
def test_round_trip(spark, library, partitions, size):
    documents = [(k, cases.prose(k, n)) for k, n in enumerate([1, 3, 700, 40, 64, 2, 2, 2, 0, 35, 90, 11] * 6)] + [(1000, None), (1001, "")]
    rows = packing.pack(cases.frame(spark, documents).repartition(partitions), queries.vocabulary(), size=size, windows=3, neighbours=4).collect()
    check(rows, documents, library, size)


def test_awkward_rows_and_digest(spark, library):
    from zlib import crc32

    from pyspark.sql import functions as F
    documents = cases.awkward()
    df = packing.pack(cases.frame(spark, documents), queries.vocabulary(), derive={"ids_crc32": F.crc32})
    rows = df.collect()
    check(rows, documents, library, 1024)
    assert all(r["ids_crc32"] == crc32(bytes(r["ids"])) for r in rows)
    assert packing.pack(cases.frame(spark, []), queries.vocabulary()).count() == 0


def test_places_equal_a_dictionary():
    import numpy as np
    rng = np.random.default_rng(1)
    places, known = packing.Places(), {}
    for size in (1, 5, 3000, 40_000, 7):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).view(np.uint64) & np.uint64(0xFFFFFFFFFFFF000F))  # many share their first place
        keys = keys[[int(k) not in known for k in keys]]
        assert (places.find(keys) == -1).all()
        places.add(keys)
        known |= {int(k): len(known) + j for j, k in enumerate(keys)}
        every = np.array(sorted(known), np.uint64)
        assert places.find(every).tolist() == [known[int(k)] for k in every] and places.used == len(known)


def test_words_encoded_many_at_a_time():
    import random

    import numpy as np
    own = packing.Tokenizer(queries.vocabulary())
    assert own.mark is not None
    rng = random.Random(2)
    letters = "abzé日!?'-.9\U0001f600 "
    words = [rng.choice(["", " "]) + "".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)] + ["\n", "\n\n", " ", "\t", "\r\n  "]
    flat, count = own._encoded(words, block=64)
    ends = np.cumsum(count)
    for word, a, b in zip(words, ends - count, ends):
        assert flat[a:b].tolist() == own.library.encode(word, add_special_tokens=False).ids
    own.mark = None  # a tokenizer that does not part words at line feeds
    again, n = own._encoded(words)
    assert (again == flat).all() and (n == count).all()
