"""A class-based bigram language model: words in classes found by exchange clustering.

P(word | previous) = P(class | previous class) * P(word | class).  Exact counts of every training word come from one distributed
sum; the vocabulary stays a distributed table.  Every word that occurs at least `often` times is clustered by itself; the
others, known or not, take the class of the bucket of their last bytes.  The `units` most frequent words and the buckets
are exchanged one by one for a start, the other words beginning in their bucket's class.  Then follow rounds over all words, a
Spark job each: the counts of the classes before and after every word are summed exactly, and each word moves to the class where
the likelihood is greatest by the class bigrams of the round.  A round that does not raise the likelihood is undone and ends
them.  Scoring holds the classes and counts of these words in every task and joins the counts of the others.

Smoothing: P(c' | c) = (n(c, c') + a P(c')) / (n(c) + a); P(w | c) = (n(w) + 1) / (n(c) + V(c) + 1) with V(c) the
distinct training words of the class.  Words are known by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import textops as T
from seqrec.llm.ship import ship
from seqrec.session import cut

END = np.uint64(0xE0D0_0000_0000_0E0D)
_MERGE_AT = 2_000_000


@dataclass(frozen=True)
class Model:
    """The vocabulary table (word, n) and what scoring needs of it; see fit()."""

    vocabulary: DataFrame
    tokens: int
    words: int
    least_held: int
    held_words: np.ndarray
    held_counts: np.ndarray
    held_units: np.ndarray
    units: int
    buckets: int
    unit_class: np.ndarray
    log_next: np.ndarray
    log_size: np.ndarray


def _tokens(data, offsets, buckets):
    """Hashes of each row's tokens (its words, then END), their buckets, and each row's first token."""
    starts, ends, first = T.word_spans(data, offsets)
    low = T.LOWER[data]
    hashes = T.span_hashes(low, starts, ends)
    tail = (T.span_hashes(low, np.maximum(starts, ends - 3), ends) % np.uint64(buckets)).astype(np.int32)
    return np.insert(hashes, first[1:], END), np.insert(tail, first[1:], 0), first + np.arange(len(first))


def _summed(parts):
    keys = np.concatenate([p[0] for p in parts])
    keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return [(keys, np.bincount(which, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64), np.concatenate([p[2] for p in parts])[at])]


def _count_words(buckets: int):
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, data, offsets in T.text_chunks(batch.column(0)):
                hashes, tail, _ = _tokens(data, offsets, buckets)
                keys, at, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((keys, n, tail[at]))
                size += len(keys)
                if size > _MERGE_AT:
                    parts = _summed(parts)
                    if len(parts[0][0]) > _MERGE_AT // 2:
                        yield from _batches(parts[0])
                        parts = []
                    size = sum(len(p[0]) for p in parts)
        if parts:
            yield from _batches(_summed(parts)[0])

    return run


def _batches(part):
    for at in range(0, len(part[0]), 1 << 16):
        keys, n, tail = (x[at:at + (1 << 16)] for x in part)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(tail)], names=["word", "n", "tail"])


def _index(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """What _find() needs of the sorted words: the words and a last one, where each value of their leading bits begins, and
    the shift to these bits."""
    bits = max(1, len(words).bit_length() - 1)
    shift = np.uint64(64 - bits)
    starts = np.zeros((1 << bits) + 1, np.int32 if len(words) < 1 << 31 else np.int64)
    np.cumsum(np.bincount((words >> shift).astype(np.int64), minlength=1 << bits), out=starts[1:])
    return np.append(words, np.uint64((1 << 64) - 1)), starts, shift


def _find(index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the sorted words (one after the last included), and whether it is there."""
    words, starts, shift = index
    at = starts[hashes >> shift].astype(np.int64)
    some = np.flatnonzero(words[at] < hashes)
    while len(some):
        at[some] += 1
        some = some[words[at[some]] < hashes[some]]
    return at, (words[at] == hashes) & (at < len(words) - 1)


def _unit_pairs(words, unit_of, tail_of, end: int, buckets: int):
    """Counts of neighbouring units: unit_of of the words (a broadcast, as they are), tail_of of the buckets of others."""
    total = end + 1

    def run(batches):
        index, count = _index(words.value), np.zeros(total * total, np.int64)
        for batch in batches:
            for _, data, offsets in T.text_chunks(batch.column(0)):
                hashes, tail, _ = _tokens(data, offsets, buckets)
                at, hit = _find(index, hashes)
                unit = tail_of[tail].astype(np.int64)
                unit[hit] = unit_of.value[at[hit]]
                unit[hashes == END] = end
                before = np.append(end, unit[:-1])  # a text follows the end of another
                count += np.bincount(before * total + unit, minlength=total * total)
        some = np.flatnonzero(count)
        for at in range(0, len(some), 1 << 16):
            part = some[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], names=["pair", "n"])

    return run


def _pairs_of(text: DataFrame, words: np.ndarray, unit_of: np.ndarray, tail_of: np.ndarray, end: int, buckets: int) -> np.ndarray:
    """pairs[u, v]: how often unit v follows u."""
    sc = text.sparkSession.sparkContext
    run = _unit_pairs(sc.broadcast(words), sc.broadcast(unit_of), tail_of, end, buckets)
    seen = text.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((end + 1) * (end + 1))
    pairs[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    return pairs.reshape(end + 1, end + 1)


def _packed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; differences of sorted ones are mostly zeros."""
    return zlib.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T.tobytes(), "<i8")


def _added(parts):
    """Sorted keys and the sums of their counts."""
    keys, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _neighbour_counts(words, own, buckets: int, classes: int, edges: np.ndarray):
    """Per part of the items (words, then buckets) packed (key, n): key = (item * 2 + side) * (classes + 1) + class, the class
    after the item (side 0) or before it (side 1)."""
    wide = classes + 1

    def run(batches):
        index, parts, size = _index(words.value), [], 0
        for batch in batches:
            for _, data, offsets in T.text_chunks(batch.column(0)):
                hashes, tail, _ = _tokens(data, offsets, buckets)
                at, hit = _find(index, hashes)
                item = np.where(hit, at, len(words.value) + tail.astype(np.int64))
                klass = own.value[item].astype(np.int64)
                inside = hashes != END
                klass[~inside] = classes
                # the last token of a chunk is an end
                after = (item * 2 * wide)[inside] + np.append(klass[1:], classes)[inside]
                before = (item * 2 * wide)[inside] + wide + np.append(classes, klass[:-1])[inside]
                keys, n = np.unique(np.concatenate([after, before]), return_counts=True)
                parts.append((keys, n))
                size += len(keys)
                if size > _MERGE_AT:
                    parts = [_added(parts)]
                    if len(parts[0][0]) > _MERGE_AT // 2:
                        yield split(parts[0])
                        parts = []
                    size = sum(len(p[0]) for p in parts)
        if parts:
            yield split(_added(parts))

    def split(part):
        keys, n = part
        cuts = np.searchsorted(keys, edges * 2 * wide)
        some = [k for k in range(len(edges) - 1) if cuts[k] < cuts[k + 1]]
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([_packed(np.diff(keys[cuts[k]:cuts[k + 1]], prepend=0)) for k in some], pa.binary()),
            pa.array([_packed(n[cuts[k]:cuts[k + 1]]) for k in some], pa.binary())], names=["part", "keys", "n"])

    return run


def _read(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(keys)), _unpacked(n)


def _merged(table: pa.Table) -> pa.Table:
    keys, n = _added([_read(k, v) for k, v in zip(table["keys"].to_pylist(), table["n"].to_pylist())])
    return pa.table({"part": table["part"][:1], "keys": pa.array([_packed(np.diff(keys, prepend=0))], pa.binary()), "n": pa.array([_packed(n)], pa.binary())})


def _joint(own, classes: int):
    """Class pairs from the items' neighbours: the class after every item, and the items after an end."""
    wide = classes + 1

    def run(batches):
        joint = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, n = _read(keys, n)
                item, rest = np.divmod(keys, 2 * wide)
                klass = own.value[item].astype(np.int64)
                after, end = rest < wide, rest == wide + classes
                np.add.at(joint, klass[after] * wide + rest[after], n[after])
                np.add.at(joint, classes * wide + klass[end], n[end])
        some = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(joint[some])], names=["pair", "n"])

    return run


def _moves(own, classes: int, edges: np.ndarray, next_: np.ndarray, last: np.ndarray):
    """The best class of every item of a part: next_[t] . after + last[t] . before is greatest; its own on ties."""
    wide, gains = classes + 1, np.concatenate([next_, last], 1).T

    def run(batches):
        for batch in batches:
            out = []
            for part, keys, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys, n = _read(keys, n)
                klass = own.value[edges[part]:edges[part + 1]].copy()
                item, rest = np.divmod(keys, 2 * wide)
                item = item - edges[part]
                for at in range(0, len(klass), 4096):
                    lo, hi = np.searchsorted(item, [at, at + 4096])
                    counts = np.zeros((min(4096, len(klass) - at), 2 * wide))
                    counts[item[lo:hi] - at, rest[lo:hi]] = n[lo:hi]
                    gain = counts @ gains
                    best, rows = gain.argmax(1), np.arange(len(counts))
                    mine = klass[at:at + 4096]
                    better = gain[rows, best] > gain[rows, mine] + 1e-9
                    klass[at:at + 4096] = np.where(better, best, mine)
                out.append(klass.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["part", "own"])

    return run


def _likelihood(joint: np.ndarray) -> float:
    """Of the class bigrams, but for what no class changes; the pair of two ends is left out."""
    joint = joint.copy()
    joint[-1, -1] = 0
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(joint) - f(joint.sum(1)) - f(joint.sum(0))


def _round(text: DataFrame, words: np.ndarray, own: np.ndarray, buckets: int, classes: int, tokens: int, prior: float) -> tuple[np.ndarray, float]:
    """New classes of all items by one pass over the texts, and the likelihood before it."""
    sc = text.sparkSession.sparkContext
    items = len(words) + buckets
    edges = np.unique(np.linspace(0, items, max(64, tokens // 1_000_000) + 1).astype(np.int64))
    word_value, own_value = sc.broadcast(words), sc.broadcast(own)
    counts = text.mapInArrow(_neighbour_counts(word_value, own_value, buckets, classes, edges), "part int, keys binary, n binary")
    counts = cut(counts.groupBy("part").applyInArrow(_merged, "part int, keys binary, n binary"), "neighbours")
    seen = counts.mapInArrow(_joint(own_value, classes), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros((classes + 1) ** 2)
    joint[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    joint = joint.reshape(classes + 1, classes + 1)
    row, col = joint.sum(1), joint.sum(0)
    # the slope of the likelihood: log n(t, c) - log n(t) for the classes after, log n(c, t) - log n(t) for those before
    smooth = joint + prior * np.outer(row + 1, col + 1) / (joint.sum() + 1) / (row + prior)[:, None]
    next_ = np.log(smooth) - np.log(row + 1)[:, None]
    last = (np.log(smooth) - np.log(col + 1)).T
    new = own.copy()
    for r in counts.mapInArrow(_moves(own_value, classes, edges, next_[:-1], last[:-1]), "part int, own binary").toLocalIterator():
        new[edges[r["part"]]:edges[r["part"] + 1]] = np.frombuffer(r["own"], "<i2")
    return new, _likelihood(joint)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of every unit: each in turn moves where the class bigrams' likelihood is greatest, until a round moves none.

    pairs[u, v] counts v after u.  Units start in order of frequency, dealt out over the classes.
    """
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    size = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-size, kind="stable")
    own = np.zeros(len(pairs), np.int64)
    own[order] = np.arange(len(pairs)) % classes
    member = np.zeros((len(pairs), classes))
    member[np.arange(len(pairs)), own] = 1
    joint = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            after, before, self_ = pairs[u] @ member, pairs[:, u] @ member, pairs[u, u]
            k = own[u]
            after[k] -= self_
            before[k] -= self_
            joint[k] -= after
            joint[:, k] -= before
            joint[k, k] -= self_
            row, col = joint.sum(1), joint.sum(0)
            gain = (f(joint + after) - f(joint)).sum(1) + (f(joint + before[:, None]) - f(joint)).sum(0)
            # the diagonal of a class takes both sums and the unit after itself
            d = np.diag(joint)
            gain += f(d + after + before + self_) - f(d + after) - f(d + before) + f(d)
            gain -= f(row + pairs[u].sum()) - f(row) + f(col + pairs[:, u].sum()) - f(col)
            to = int(gain.argmax())
            if gain[to] <= gain[k] + 1e-9:
                to = k
            joint[to] += after
            joint[:, to] += before
            joint[to, to] += self_
            if to != k:
                member[u, k], member[u, to], own[u] = 0, 1, to
                moved += 1
        if not moved:
            break
    return own


def fit(train: DataFrame, text_col: str = "text", units: int = 1024, buckets: int = 512, classes: int | None = None, rounds: int = 8,
        held: int | None = None, prior: float = 64.0, often: int = 2, passes: int = 2) -> Model:
    """Learns from all rows; a null text counts as empty, its only token being the end.

    classes: by default the cube root of the clustered words, 64 at least.  held: at most so many words are clustered and held;
    by default all that occur at least `often` times, rarer ones being held too if all fit in 2^18.  rounds: of the start;
    passes: at most so many rounds over all words.
    """
    ship(train.sparkSession)
    text = train.select(F.col(text_col).cast("string").alias("text"))
    counts = text.mapInArrow(_count_words(buckets), "word bigint, n bigint, tail int").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))
    vocabulary = cut(counts, "vocabulary")
    # the least count that at most `held` words reach, from a histogram of counts
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64))
    steps = vocabulary.groupBy(step.alias("s")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    words, tokens = sum(r["words"] for r in steps), sum(r["tokens"] for r in steps)
    least, reached = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["s"]):
        if reached + r["words"] > (1 << 18 if held is None else held):
            break
        least, reached = r["least"], reached + r["words"]
    if held is None:
        least = min(least, often)
    got = vocabulary.where(F.col("n") >= least).toArrow()
    word, n, tail = (got[c].to_numpy() for c in ("word", "n", "tail"))
    del got
    word = word.view(np.uint64) if len(word) else np.zeros(0, np.uint64)
    order = np.argsort(word)
    word, n, tail = word[order], n[order].astype(np.int64), tail[order].astype(np.int32)
    alone = (n >= often) & (word != END)
    clustered, tails = word[alone], tail[alone]
    count = len(clustered)
    classes = classes or max(64, round(count ** (1 / 3)))
    unit = (count + tail).astype(np.int32)
    unit[alone] = np.arange(count)
    unit[word == END] = count + buckets
    # the start: the most frequent words and the buckets
    top = np.sort(np.lexsort((clustered, -n[alone]))[:units])
    end = len(top) + buckets
    pairs = _pairs_of(text, clustered[top], np.arange(len(top)), len(top) + np.arange(buckets), end, buckets) if tokens else np.zeros((end + 1, end + 1))
    start = exchange(pairs[:-1, :-1], classes, rounds).astype(np.int16)
    own = np.append(start[len(top):][tails], start[len(top):])
    own[top] = start[:len(top)]
    best, before = own, -np.inf
    for _ in range(passes if count else 0):
        new, likelihood = _round(text, clustered, own, buckets, classes, tokens, prior)
        if likelihood <= before:
            own = best
            break
        best, before = own, likelihood
        if (new == own).all():
            break
        own = new
    joint = _pairs_of(text, clustered, own[:count], own[count:], classes, buckets) if tokens else np.zeros((classes + 1, classes + 1))
    if own is not best and _likelihood(joint) < before:
        own = best
        joint = _pairs_of(text, clustered, own[:count], own[count:], classes, buckets)
    unit_class = np.append(own, np.int16(classes))  # the end has a class of its own
    share = (joint.sum(0) + 1) / (joint.sum() + classes + 1)
    log_next = np.log10((joint + prior * share) / (joint.sum(1, keepdims=True) + prior))
    # tokens and distinct words of every class: held words by their unit, the others by their bucket
    others = vocabulary.where(F.col("n") < least).groupBy("tail").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    size, distinct = np.zeros(classes + 1), np.zeros(classes + 1)
    np.add.at(size, unit_class[unit], n)
    np.add.at(distinct, unit_class[unit], 1)
    for r in others:
        size[unit_class[count + r["tail"]]] += r["n"]
        distinct[unit_class[count + r["tail"]]] += r["words"]
    return Model(vocabulary, int(tokens), int(words), least, word, n, unit, count, buckets, unit_class, log_next, np.log10(size + distinct + 1))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens (bigint), base_score, score and perplexity (double).

    base_score is the add-one unigram log10 probability, score the model's; perplexity is 10 ** (-score / n_tokens).
    Existing columns of these names are replaced.
    """
    ship(docs.sparkSession)
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    most = model.held_counts.max(initial=0)
    small = {k: getattr(model, k) for k in ("held_words", "buckets", "log_next", "log_size")}
    small |= {"held_counts": model.held_counts.astype(np.uint32 if most < 1 << 32 else np.int64), "held_class": model.unit_class[model.held_units],
              "tail_class": model.unit_class[model.units:]}
    value = docs.sparkSession.sparkContext.broadcast(small)
    kind = "struct<rid:bigint,n_tokens:bigint,known:bigint,seen:double,path:double,words:array<bigint>,times:array<int>>"
    fields = ["rid", "n_tokens", "known", "seen", "path", "words", "times"]

    @F.arrow_udf(kind)
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = value.value
        index, counts, buckets, tail_class = _index(m["held_words"]), m["held_counts"], m["buckets"], m["tail_class"]
        end_class = tail_class[-1]
        rid = TaskContext.get().partitionId() << 40
        for column in columns:
            out = []
            for _, data, offsets in T.text_chunks(column):
                hashes, tail, first = _tokens(data, offsets, buckets)
                rows, n = len(offsets) - 1, np.diff(first)
                at, hit = _find(index, hashes)
                klass = tail_class[tail].astype(np.int64)
                klass[hit] = m["held_class"][at[hit]]
                klass[hashes == END] = end_class
                path = m["log_next"][np.append(end_class, klass[:-1]), klass] - m["log_size"][klass]
                seen = np.zeros(len(hashes))
                seen[hit] = np.log10(counts[at[hit]] + 1.0)
                row = np.repeat(np.arange(rows), n)
                # rare words: (row, word) with how often
                rare_row, rare = row[~hit], hashes[~hit]
                order = np.lexsort((rare, rare_row))
                rare_row, rare = rare_row[order], rare[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(rare))).astype(np.int32)
                edges = np.searchsorted(rare_row[start], np.arange(rows + 1)).astype(np.int32)
                out.append(pa.StructArray.from_arrays([
                    pa.array(rid + np.arange(rows)), pa.array(n.astype(np.int64)), pa.array(T.row_sums(hit.astype(np.int64), first)),
                    pa.array(np.bincount(row, seen, rows)), pa.array(np.bincount(row, path, rows)),
                    pa.ListArray.from_arrays(edges, pa.array(rare[start].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(times))], names=fields))
                rid += rows
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("rid", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("seen", pa.float64()),
                                                                             ("path", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))

    judged = cut(docs.select(F.struct(*rest).alias("_row"), judge(F.col(text_col).cast("string")).alias("j")).select("_row", "j.*"), "judged")
    rare = judged.select("rid", F.explode(F.arrays_zip("words", "times")).alias("r")).select("rid", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    known = model.vocabulary.where(F.col("n") < model.least_held).select("word", "n")
    sums = rare.join(known, "word").groupBy("rid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_seen"))
    zero = F.lit(0.0)
    all_seen = F.col("seen") + F.coalesce("more_seen", zero)
    out = judged.drop("words", "times").join(sums, "rid", "left").select(
        "_row.*", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (all_seen - F.col("n_tokens") * float(np.log10(model.tokens + model.words + 1))).alias("base_score"), (all_seen + F.col("path")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
