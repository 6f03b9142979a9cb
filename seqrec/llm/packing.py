"""Bounded-space online packing of token ids into fixed windows.

Every partition is one stream with a fixed number of open windows.  Whole windows are cut off a long document at once; what is
left goes best-fit into the open window with the least sufficient room, or opens one.  When none fits, the
fullest window is filled with the document's next ids and emitted, so it carries no padding.  The windows still open
at the end of a partition are few; those of neighbouring partitions are merged, and the tail is cut at powers of two.

Texts are tokenized by distinct word: a byte-level pre-tokenizer never joins what white space parts, so every word, with the
space before it, has the same ids wherever it stands.  Texts with white space beyond ASCII are tokenized whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm import textops as T
from seqrec.llm.ship import ship
from seqrec.session import cut

CHUNK = 1 << 21
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("part", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def other_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold Unicode white space other than ASCII's."""
    b = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two, three = b[:-2], b[1:-1], b[2:]
    lead = np.flatnonzero(one >= 0xC2)
    a, b, c = one[lead], two[lead], three[lead]
    hit = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | (
        (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, lead[hit], "right") - 1] = True
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of each row that are tokenized apart, and each row's first piece.

    A word takes the single space before it; of the white space before that, or before a word without one, the
    last character stands alone if it is no space; white space at the end of a text is one piece.
    """
    starts, ends, first = T.word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    before = np.where(starts > 0, ends[np.maximum(np.arange(len(starts)) - 1, 0)], 0)
    before = np.where(np.arange(len(starts)) == first[row], offsets[row], before)  # where the white space before a word begins
    gap = starts - before
    spaced = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20)
    cut_at = starts - (gap > 0)
    runs = cut_at > before
    alone = (gap > 0) & ~spaced
    last = np.where(np.diff(first) > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
    tails = offsets[1:] > last
    begin = np.concatenate([before[runs], cut_at[alone], np.where(spaced, cut_at, starts), last[tails]])
    end = np.concatenate([cut_at[runs], starts[alone], ends, offsets[1:][tails]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    return begin, end, np.searchsorted(begin, offsets)


class Places:
    """Numbers 0, 1, ... of 64-bit keys in the order in which they are added: open addressing, looked up for whole arrays at once."""

    def __init__(self):
        self.used = 0
        self.key, self.number = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those not there."""
        mask = np.uint64(len(self.key) - 1)
        at = (keys & mask).astype(np.int64)
        out = self.number[at]
        left = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            out[left] = self.number[at[left]]
            left = left[(out[left] >= 0) & (self.key[at[left]] != keys[left])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds keys that are all different and not there."""
        if 2 * (self.used + len(keys)) > len(self.key):
            kept = np.zeros(self.used, np.uint64)
            there = self.number >= 0
            kept[self.number[there]] = self.key[there]
            size = 1 << int(4 * (self.used + len(keys)) - 1).bit_length()
            self.key, self.number, self.used = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
            self.add(kept)
        mask = len(self.key) - 1
        number = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        at, left = (keys & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.number[at[left]] < 0
            self.number[at[left[free]]] = number[left[free]]  # of several for one place the last stays
            self.key[at[left[free]]] = keys[left[free]]
            left = left[self.number[at[left]] != number[left]]
            at[left] = (at[left] + 1) & mask
        self.used += len(keys)


class Tokenizer:
    """Ids of texts by a tokenizers file, remembered by distinct piece; the memory is dropped when it holds `most` of them."""

    def __init__(self, path: str, most: int = 3_000_000):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        self.most = most
        self.mark = self._mark()
        self.forget()

    def forget(self) -> None:
        self.slots = Places()
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used, self.pooled = np.zeros(0, np.uint32), 0, 0

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))

    def _mark(self) -> int | None:
        """The id of a line feed, if words encoded in one text with line feeds between them have the ids they have alone."""
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        feed = ids("\n")
        words = ["a", " b", "!", " ?!", "'s", "9", " -9", "é", "日本", "x", ".."]
        joined = [i for w in words for i in ids(w) + feed]
        return feed[0] if len(feed) == 1 and ids("\n".join(words) + "\n") == joined else None

    def _encoded(self, texts: list[str], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and their numbers.  Words are encoded many at a time, with line feeds between them to find their ends."""
        count = np.zeros(len(texts), np.int64)
        plain = [k for k, t in enumerate(texts) if t.strip()] if self.mark is not None else []
        apart = set(range(len(texts))).difference(plain)
        parts: list = [None] * len(texts)
        blocks = [plain[k:k + block] for k in range(0, len(plain), block)]
        for members, e in zip(blocks, self.library.encode_batch_fast(["\n".join([texts[k] for k in m]) + "\n" for m in blocks], add_special_tokens=False) if blocks else []):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(members):
                apart.update(members)
                continue
            begin = np.append(0, ends[:-1] + 1)
            count[members] = ends - begin
            for k, a, b in zip(members, begin.tolist(), ends.tolist()):
                parts[k] = ids[a:b]
        rest = sorted(apart)
        if rest:
            flat, n = self._one_by_one([texts[k] for k in rest])
            count[rest] = n
            for k, a, b in zip(rest, (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
                parts[k] = flat[a:b]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        flat, count = self._encoded(texts)
        if self.used + len(keys) > len(self.begin):
            more = np.zeros(self.used + 2 * len(keys), np.int64)
            self.begin, self.count = np.concatenate([self.begin[:self.used], more]), np.concatenate([self.count[:self.used], more])
        if self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.pooled], np.zeros(self.pooled + 2 * len(flat), np.uint32)])
        self.begin[self.used:self.used + len(keys)] = self.pooled + np.cumsum(count) - count
        self.count[self.used:self.used + len(keys)] = count
        self.pool[self.pooled:self.pooled + len(flat)] = flat
        self.slots.add(keys)
        self.used += len(keys)
        self.pooled += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's ids begin and the last ends)."""
        if self.used > self.most:
            self.forget()
        begin, end, first = units(data, offsets)
        hashes = T.span_hashes(data, begin, end)
        slot = self.slots.find(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            keys, at = np.unique(hashes[missing], return_index=True)
            raw = data.tobytes()
            self._learn(keys, [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[missing[at]].tolist(), end[missing[at]].tolist())])
            slot[missing] = self.slots.find(hashes[missing])
        count = self.count[slot]
        owner, inside = T.ragged(count)
        ids = self.pool[self.begin[slot][owner] + inside] if len(owner) else np.zeros(0, np.uint32)
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[first]
        odd = np.flatnonzero(other_space(data, offsets))
        if len(odd):
            rows = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
            for k in odd:
                text = data[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "replace")
                rows[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(rows)
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in rows])])
        return ids, edges


_tokenizers: dict[str, Tokenizer] = {}


class _Packer:
    """The open windows of one stream; rows() gives the pieces of the windows emitted so far."""

    def __init__(self, part: int, size: int, windows: int):
        self.part, self.size, self.windows = part, size, windows
        self.open: list[list] = []  # [room, pieces]
        self.next = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, whole in pieces:
            self.out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), whole, self.part, self.next, at, is_open))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole, start = len(ids), 0
        while whole - start >= self.size:
            self._emit([(doc, start, ids[start:start + self.size], whole)])
            start += self.size
        while start < whole:
            rest = whole - start
            fits = [w for w in self.open if w[0] >= rest]
            if fits:
                window = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = [self.size, []]
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
            take = min(rest, window[0])
            window[1].append((doc, start, ids[start:start + take], whole))
            window[0] -= take
            start += take
            if not window[0]:
                self.open = [w for w in self.open if w is not window]
                self._emit(window[1])

    def close(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, True)
        self.open = []

    def rows(self) -> pa.RecordBatch:
        got, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * len(SCHEMA), SCHEMA.types)], schema=SCHEMA)


def _merged(size: int):
    """Windows of some partitions, emptied in order into full ones; the tail is cut at powers of two."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.to_pylist()]
        total = sum(len(p[2]) for p in pieces)
        limits = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (total % size) >> b & 1]
        packer = _Packer(table["part"][0].as_py(), size, 0)
        packer.next = 1 << 32  # behind the windows that the partition has emitted itself
        k, now = 0, []
        room = limits[0]
        for doc, start, ids, whole in pieces:
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                now.append((doc, start + at, ids[at:at + take], whole))
                at += take
                room -= take
                if not room:
                    packer._emit(now)
                    now, k = [], k + 1
                    room = limits[k] if k < len(limits) else 0
        return pa.Table.from_batches([packer.rows()])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, windows: int = 8, end_id: int = 0, neighbours: int = 8,
         id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Callable[[Column], Column]] | None = None, ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) and the derived columns.

    A document is the ids of its text (null: empty), by the tokenizers file at the path, and end_id; each id lies in exactly
    one piece, pieces fill a sequence from offset 0 without gaps.  Sequences hold `size` ids, but for tails of lengths that are powers
    of two.  `derive` gives columns computed from a piece's ids; ids=False leaves the ids themselves out, which keeps the
    written table small.  Rows are packed as they come, so repeated rows are packed repeatedly; a null id stays null; other columns
    are ignored.  `neighbours` partitions share their leftovers.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    ship(docs.sparkSession)

    def run(batches):
        library = _tokenizers.get(tokenizer) or _tokenizers.setdefault(tokenizer, Tokenizer(tokenizer))
        packer = _Packer(TaskContext.get().partitionId(), size, windows)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for begin, data, offsets in T.text_chunks(batch.column(1), CHUNK):
                got, edges = library.encode(data, offsets)
                for k in range(len(offsets) - 1):
                    packer.add(names[begin + k], np.append(got[edges[k]:edges[k + 1]], np.uint32(end_id)))
                yield packer.rows()
        packer.close()
        yield packer.rows()

    derive = derive or {}
    kept = ["doc_id", "start", "length", "doc_tokens", "part", "window", "offset"]
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, part bigint, window bigint, offset bigint, open boolean"
    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    pieces = cut(pieces.select(*kept, "open", F.when(F.lit(ids) | F.col("open"), F.col("ids")).alias("ids"), *[f(F.col("ids")).alias(n) for n, f in derive.items()]), "pieces")
    left = pieces.where("open").select("doc_id", "start", "length", "ids", "doc_tokens", "part", "window", "offset", "open")
    merged = left.groupBy(F.floor(F.col("part") / neighbours).alias("_block")).applyInArrow(_merged(size), schema)
    merged = merged.select(*kept, "ids", *[f(F.col("ids")).alias(n) for n, f in derive.items()])
    both = pieces.where("not open").select(merged.columns).unionByName(merged)
    sequence = F.shiftleft("part", 34) + F.col("window")
    return both.select("doc_id", "start", "length", "doc_tokens", sequence.alias("sequence_id"), "offset", *(["ids"] if ids else []), *derive)
