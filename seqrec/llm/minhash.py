"""Near-duplicate texts: consistent weighted samples of TF-IDF shingles, banded, then verified exactly.

A text is the bag of its five-word shingles (lower-cased A-Z; a shorter text is one shingle).  The weight of
a shingle is its count times the mean, over its words, of the square root of the inverse document frequency (1 + ln of the share's
inverse); the root keeps rare words from outvoting the rest of a text.  Word frequencies stand
for shingle frequencies on purpose: a shingle's own frequency falls apart with the number of its copies, so large
groups of copies would talk themselves below the threshold.  They are kept by hash bucket, so the table that
tasks read has a fixed size whatever the input.

Improved consistent weighted sampling draws one (shingle, level) per hash function with collision probability equal
to the weighted Jaccard similarity.  `rows` samples make a band; documents that share a band are candidates.  Members
of a bucket are compared with its least document first.  Where a bucket then still holds several components, the documents of
different ones are compared too: in a small bucket all of them, in large ones those that share a rare shingle (an exact
prefix filter), so that documents which merely share a passage never meet.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import textops as T
from seqrec.llm.graph import components
from seqrec.llm.ship import ship
from seqrec.session import cut

_U = np.uint64
_PARAMS = 4096


def _numbers(seed: int, samples: int) -> tuple[np.ndarray, ...]:
    """r, 1/r, beta and log c of the sampling, each drawn for 4096 values of a different part of a shingle's hash."""
    rng = np.random.default_rng(seed)
    shape = (_PARAMS, samples)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32) + np.float32(1e-6)
    return r, 1 / r, rng.random(shape, np.float32), np.log(rng.gamma(2.0, 1.0, shape) + 1e-30).astype(np.float32)


def _words(data, offsets):
    """Hashes of the words, lower-cased, and each row's first word."""
    starts, ends, first = T.word_spans(data, offsets)
    return T.span_hashes(T.LOWER[data], starts, ends), first


def _fingerprints(hashes, first):
    """Two 64-bit hashes of the word sequence of each row, as signed numbers."""
    up, down = T._power_tables(len(hashes) + 1)
    return [T.mix(T.row_sums(T.mix(hashes ^ _U(salt)) * up[:len(hashes)], first) * down[first[:-1]] + np.diff(first).astype(_U)).view(np.int64)
            for salt in (0x51ED270B, 0x2545F4914F6CDD1D)]


def weighted_shingles(hashes, first, width, idf):
    """(row, hash, weight) of the distinct shingles of each row, ordered by row and hash."""
    at, taken, row = T.shingles(hashes, first, width)
    if not len(at):
        return row, np.zeros(0, _U), np.zeros(0, np.float32)
    value = T.shingle_hashes(hashes, at, taken, width)
    each = idf[(hashes % _U(len(idf))).astype(np.int64)]
    total = np.zeros(len(at), np.float32)
    padded = np.concatenate([each, np.zeros(width, np.float32)])
    for k in range(width):
        total += np.where(taken > k, padded[at + k], np.float32(0))
    order = np.lexsort((value, row))
    value, row, total, taken = value[order], row[order], total[order], taken[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(value)))
    return row[at], value[at], count.astype(np.float32) * (total[at] / taken[at].astype(np.float32))


def weighted_jaccard(left: pa.Array, right: pa.Array, width: int, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row; 0 where either has no word."""
    out = np.zeros(len(left))
    cuts = sorted({c[0] for side in (left, right) for c in T.text_chunks(side)})
    for begin, end in zip(cuts, [*cuts[1:], len(left)]):
        sides = []
        for column in (left, right):
            _, data, offsets = next(T.text_chunks(column.slice(begin, end - begin), 1 << 62))
            row, value, weight = weighted_shingles(*_words(data, offsets), width, idf)
            sides.append((row, T.mix(value + T.mix(row.astype(_U))), weight.astype(np.float64)))
        (row_a, key_a, w_a), (row_b, key_b, w_b) = sides
        n = end - begin
        _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
        both = np.bincount(row_a[ia], np.minimum(w_a[ia], w_b[ib]), n)
        whole = np.bincount(row_a, w_a, n) + np.bincount(row_b, w_b, n) - both
        out[begin:end] = np.divide(both, whole, out=np.zeros(n), where=whole > 0)
    return out


def _profile(width: int, buckets: int):
    """Per document the fingerprint of its words; per partition the documents that hold each word bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("words", pa.int64()),
                        ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            out = []
            for _, data, offsets in T.text_chunks(batch.column(1)):
                hashes, first = _words(data, offsets)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                keys = np.unique(row * buckets + (hashes % _U(buckets)).astype(np.int64))
                held += np.bincount(keys % buckets, minlength=buckets)
                out.append((*_fingerprints(hashes, first), n))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, cols),
                                                  pa.nulls(len(cols[0]), pa.int32()), pa.nulls(len(cols[0]), pa.int64())], schema=schema)
        some = np.flatnonzero(held)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some.astype(np.int32)), pa.array(held[some])], schema=schema)

    return run, "doc_id bigint, f1 bigint, f2 bigint, words bigint, bucket int, n bigint"


def _signatures(width: int, bands: int, rows: int, seed: int, idf_value):
    """Band hashes of each document that has words."""
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        idf = idf_value.value
        r, inv, beta, log_c = _numbers(seed, bands * rows)
        power = np.array([pow(0xA24BAED4963EE407, k + 1, 2**64) for k in range(rows)], _U)
        band_no = T.mix(np.arange(bands, dtype=_U) + _U(1))
        for batch in batches:
            for begin, data, offsets in T.text_chunks(batch.column(1)):
                hashes, first = _words(data, offsets)
                prints = _fingerprints(hashes, first)
                row, value, weight = weighted_shingles(hashes, first, width, idf)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                log_w = np.log(weight)[:, None]
                pick = [(value >> _U(s) & _U(_PARAMS - 1)).astype(np.int64) for s in (0, 12, 24)]
                had, got = [], []
                for k in np.flatnonzero(np.diff(edges)):
                    least = None
                    for lo in range(edges[k], edges[k + 1], 2048):
                        hi = min(edges[k + 1], lo + 2048)
                        r_, b_ = r[pick[0][lo:hi]], beta[pick[1][lo:hi]]
                        level = np.floor(log_w[lo:hi] * inv[pick[0][lo:hi]] + b_)
                        score = log_c[pick[2][lo:hi]] - r_ * (level - b_ + 1)
                        at = score.argmin(0)
                        cols = np.arange(score.shape[1])
                        now = (score[at, cols], value[lo + at], level[at, cols])
                        if least is None:
                            least = now
                        else:
                            better = (now[0] < least[0]) | ((now[0] == least[0]) & (now[1] < least[1]))
                            least = tuple(np.where(better, x, y) for x, y in zip(now, least))
                    sample = T.mix(least[1] ^ T.mix(least[2].astype(np.int64).view(_U)))
                    had.append(begin + k)
                    got.append(T.mix((sample.reshape(bands, rows) * power).sum(1) + band_no))
                if had:
                    flat = np.concatenate(got).view(np.int64)
                    lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)
                    own = np.array(had) - begin
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(had)), pa.array(prints[0][own]), pa.array(prints[1][own]), lists], schema=schema)

    return run, "doc_id bigint, f1 bigint, f2 bigint, bands array<bigint>"


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float, idf_value) -> DataFrame:
    """The pairs whose texts reach the threshold, with their similarity; a written table."""

    def run(batches):
        for batch in batches:
            got = weighted_jaccard(batch.column(2), batch.column(3), width, idf_value.value)
            keep = pa.array(got >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep),
                                              pa.array(got).filter(keep)], names=["a", "b", "similarity"])

    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    texts = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return cut(texts.mapInArrow(run, "a bigint, b bigint, similarity double"), "links")


def _rare_shingles(docs: DataFrame, crowded: DataFrame, width: int, threshold: float, idf_value, buckets: int = 1 << 20) -> DataFrame:
    """(doc, part, shingle, after, whole): the rarest shingles of each crowded document, by which any link of two of them shows.

    after is the document's weight from this shingle on, in one order of all shingles, and whole its weight altogether.  Two
    documents whose weighted Jaccard similarity is t share at least t / (1 + t) of their summed weights, all of it from their first
    common shingle on: so that shingle is here, and `after` of both is at least that much.  Any order will do; the one by how
    many crowded documents hold a shingle (counted by hash bucket, a table of fixed size) keeps passages that many share out.
    """
    texts = cut(docs.join(crowded.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "part", "text"), "crowded")

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in T.text_chunks(batch.column(0)):
                held += np.bincount((weighted_shingles(*_words(data, offsets), width, idf_value.value)[1] % _U(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    held = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    order = np.zeros(buckets, np.int32)
    order[held["bucket"].to_numpy(np.int64)] = np.minimum(held["n"].to_numpy(np.int64), np.iinfo(np.int32).max)
    order_value = texts.sparkSession.sparkContext.broadcast(order)

    def rare(batches):
        for batch in batches:
            for begin, data, offsets in T.text_chunks(batch.column(2)):
                row, value, weight = weighted_shingles(*_words(data, offsets), width, idf_value.value)
                by = np.lexsort((value, order_value.value[(value % _U(buckets)).astype(np.int64)], row))
                row, value, weight = row[by], value[by], weight[by].astype(np.float64)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                before = np.cumsum(weight) - weight
                whole = T.row_sums(weight, edges)[row]
                after = whole - (before - before[np.minimum(edges[:-1], max(0, len(before) - 1))][row])
                keep = after >= threshold * whole * (1 - 1e-6)
                at = pa.array(begin + row[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(value[keep].view(np.int64)), pa.array(after[keep]), pa.array(whole[keep])],
                                                 names=["doc", "part", "shingle", "after", "whole"])

    return cut(texts.mapInArrow(rare, "doc bigint, part bigint, shingle bigint, after double, whole double"), "rare")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    threshold: float = 0.8, bands: int = 20, rows: int = 5, idf_buckets: int = 1 << 18,
                    small: int = 32, seed: int = 7) -> dict[str, DataFrame]:
    """{"classes": (doc_id, class_id, kept), "links": (a, b, similarity)}.

    classes has one row per input row: the smallest doc_id of its class, and whether it is that one.  links holds the
    verified pairs between the least documents of different word sequences.  Equal word sequences are one class
    without being compared.  Texts that are null, empty or without a word link with nothing; rows with
    the same doc_id count as one document; a null doc_id gets class_id null and kept true.  Other columns are ignored.
    With similarity 0.8 a pair shares one of 20 bands of 5 samples with probability 0.9996.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _profile(width, idf_buckets)
    profile = cut(docs.mapInArrow(run, schema), "profiles")
    prints = profile.where("bucket is null").select("doc_id", "f1", "f2", "words")
    held = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n_docs = prints.count()
    df = np.zeros(idf_buckets)
    df[held["bucket"].to_numpy(np.int64)] = held["n"].to_numpy(float)
    idf_value = spark.sparkContext.broadcast(np.sqrt(1 + np.log((1 + n_docs) / (1 + df))).astype(np.float32))

    firsts = prints.where("words > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    signed = cut(docs.mapInArrow(*_signatures(width, bands, rows, seed, idf_value)), "signatures")
    signed = signed.join(firsts, ["f1", "f2"]).where("doc_id = first")
    member = cut(signed.select(F.col("first").alias("doc"), F.posexplode("bands").alias("band", "value")).distinct(), "buckets")

    pivots = member.groupBy("band", "value").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where("b < last")
    star = member.join(pivots.drop("last"), ["band", "value"]).where("doc <> b").select(F.col("doc").alias("a"), "b")
    star = cut(star.distinct(), "pairs")
    # all documents that share a bucket are here: only their texts are moved, and once
    shared = star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    docs = cut(docs.join(shared, "doc_id", "left_semi"), "texts")
    links = _verified(star, docs, width, threshold, idf_value)

    found = components(links)

    def labelled(found, rows_):
        return rows_.drop("part").join(found, rows_["doc"] == found["node"], "left").withColumn("part", F.coalesce("component", "doc")).drop("node", "component")

    def joined(found, more):
        """Components after more links, of which few join different ones."""
        a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
        again = components(more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")))
        again = again.select(F.col("node").alias("of"), F.col("component").alias("to"))
        old = found.join(again, found["component"] == again["of"], "left").select("node", F.coalesce("to", "component").alias("component"))
        return cut(old.unionByName(again.select(F.col("of").alias("node"), F.col("to").alias("component"))).distinct(), "components")

    def mixed(rows_, *key):
        sizes = rows_.groupBy(*key).agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size"))
        return rows_.join(sizes.where("lo < hi").drop("lo", "hi"), list(key))

    def across(rows_, key, enough=None):
        rows_ = rows_.drop("size")
        other = rows_.select(*[F.col(c).alias(c if c in key else f"{c}_b") for c in rows_.columns])
        apart = (F.col("doc") < F.col("doc_b")) & (F.col("part") != F.col("part_b"))
        same = [rows_[c] == other[c] for c in key]
        return rows_.join(other, reduce(and_, same) & (apart if enough is None else apart & enough)).select(F.col("doc_b").alias("a"), F.col("doc").alias("b"))

    open_ = cut(mixed(labelled(found, member), "band", "value"), "open")
    crowded = open_.where(F.col("size") > small).select("doc", "part").distinct()
    more = across(open_.where(F.col("size") <= small), ["band", "value"])
    if not crowded.isEmpty():
        enough = F.least("after", "after_b") >= threshold / (1 + threshold) * (1 - 1e-6) * (F.col("whole") + F.col("whole_b"))
        more = more.unionByName(across(mixed(_rare_shingles(docs, crowded, width, threshold, idf_value), "shingle"), ["shingle"], enough))
    more = cut(more.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        new = _verified(more, docs, width, threshold, idf_value)
        links, found = links.unionByName(new), joined(found, new)
    found = found.withColumnRenamed("component", "class_id")
    classes = prints.join(firsts, ["f1", "f2"], "left").join(found, F.col("first") == found["node"], "left").select(
        "doc_id", F.when(F.col("words") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "first"))).otherwise(F.col("doc_id")).alias("class_id"))
    return {"classes": classes.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))), "links": links}
