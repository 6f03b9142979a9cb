"""Words of whole texts, taken from Arrow byte buffers without a Python loop over words.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D.  Their hashes are 64 bits wide and
depend on the word's bytes alone (A-Z lower-cased if asked for), so tasks agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).view(_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15 ^ 0x6  # odd, 3 mod 4
_SHIFT = (0xD6E8FEB86659FD93, 0xCA5A826395121157)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(32))) * _U(_SHIFT[0])
    x = (x ^ (x >> _U(32))) * _U(_SHIFT[1])
    return x ^ (x >> _U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.ones(size, _U)
            done = 1
            while done < size:
                table[done:2 * done] = table[:done] * _U(pow(base, done, 2**64))
                done *= 2
            tables.append(table)
        _powers[:] = tables
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of consecutive rows, cut before a chunk passes the limit.

    A null text counts as empty; a single text longer than the limit is a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, raw[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one entry more than rows)."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    starts = np.flatnonzero(word & (edge[:-1] | ~before[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word
    ends = np.flatnonzero(word & (edge[1:] | ~after[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position inside it) of every element of consecutive groups of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, words taken, row) of each shingle: every run of `width` words of a row.

    A row of fewer words has one shingle of them all; a row without words has none.
    """
    n = np.diff(first)
    owner, at = ragged(np.where(n == 0, 0, np.maximum(1, n - width + 1)))
    return first[owner] + at, np.minimum(width, n[owner]), owner


def shingle_hashes(hashes: np.ndarray, start: np.ndarray, taken: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes that depend on the words of a shingle and their order."""
    padded = np.concatenate([hashes, np.zeros(width, _U)])
    total = np.zeros(len(start), _U)
    for k in range(width):
        total += np.where(taken > k, mix(padded[start + k]), _U(0)) * _U(pow(0xD1342543DE82EF95, k + 1, 2**64))
    return mix(total + taken.astype(_U))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows without values give 0."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
