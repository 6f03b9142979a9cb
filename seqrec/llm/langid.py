"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a letter trigram binds the vectors of its letters, permuted by
their place, by multiplication; a text or a language is the bundle (sum) of its trigrams.  The language whose bundle
has the highest cosine with the text's is predicted.  Letters are the code points that Python counts as alphabetic,
lower-cased; a run of other characters is one boundary.  a-z have codes of their own and other letters share 37 more,
so trigrams have 2**18 codes at most, whatever the scripts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import textops as T
from seqrec.llm.ship import ship

CODES = 64
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of each code point: 0 for a boundary."""
    codes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            codes[point] = low - 96 if 97 <= low <= 122 else 27 + low % (CODES - 27)
    return codes


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram code, row) of every letter with its two neighbours."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = lead[offsets]
    codes = np.insert(_letters()[points], at[:-1], 0)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
    codes = np.append(codes, 0).astype(np.int64)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes, row = codes[keep], np.append(row, len(at) - 2)[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1
    if codes[:1].any():
        middle = np.append(0, middle)
    before = np.where(middle > 0, codes[middle - 1], 0)
    return before * CODES * CODES + codes[middle] * CODES + codes[middle + 1], row[middle]


def _bound(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Trigram vectors of +1 and -1."""
    letter = np.random.default_rng(seed).integers(0, 2, (CODES, dims), dtype=np.int8) * 2 - 1
    a, b, c = codes // (CODES * CODES), codes // CODES % CODES, codes % CODES
    return np.roll(letter, 2, 1)[a] * np.roll(letter, 1, 1)[b] * letter[c]


class _Memory:
    """Vectors of the trigrams met so far; at most 2**18 rows."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.slot = np.full(CODES**3, -1, np.int32)
        self.rows = np.zeros((0, dims), np.int8)
        self.used = 0

    def slots(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.slot[codes] < 0])
        if len(new):
            if self.used + len(new) > len(self.rows):
                grown = np.zeros((2 * (self.used + len(new)), self.dims), np.int8)
                grown[:self.used] = self.rows[:self.used]
                self.rows = grown
            self.rows[self.used:self.used + len(new)] = _bound(new, self.dims, self.seed)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.slot[codes]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and their unit vectors."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    seed: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 11) -> Profiles:
    """Language profiles of all rows with a language; each text weighs the same, whatever its length.

    Rows with a null language or text, or without a letter, teach nothing.  The driver receives one number
    per language and trigram met, at most 2**18 a language.
    """
    ship(docs.sparkSession)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for begin, data, offsets in T.text_chunks(batch.column(0)):
                code, row = trigrams(data, offsets)
                weight = 1 / np.bincount(row, minlength=len(offsets) - 1)[row]
                own = langs[begin + row] if len(row) else langs[:0]
                for lang in set(langs[begin:begin + len(offsets) - 1]):
                    of = own == lang
                    total[lang] = total.get(lang, 0) + np.bincount(code[of], weight[of], CODES**3)
        for lang, weight in total.items():
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(weight[some])],
                                             names=["lang", "code", "weight"])

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = known.mapInArrow(run, "lang string, code int, weight double").groupBy("lang", "code").agg(F.sum("weight").alias("weight")).toPandas()
    languages, rows = [], []
    for lang, part in sorted(sums.groupby("lang")):
        part = part.sort_values("code")
        bundle = part["weight"].to_numpy() @ _bound(part["code"].to_numpy(np.int64), dims, seed).astype(np.float64)
        size = np.sqrt((bundle * bundle).sum())
        if size > 0:
            languages.append(lang)
            rows.append(bundle / size)
    return Profiles(tuple(languages), np.array(rows).reshape(len(rows), dims), seed)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (existing columns of these names are replaced).

    score is the cosine with the predicted language's profile, 0 where it is negative.  A text that is null or has no
    letter, or a model without languages, gives "und" and 0; ties go to the language first in order.
    """
    ship(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = value.value
        memory = _Memory(p.vectors.shape[1], p.seed)
        names = np.array([*p.languages, UNKNOWN], object)
        for column in columns:
            best = np.full(len(column), -1)
            score = np.zeros(len(column))
            for begin, data, offsets in T.text_chunks(column):
                code, row = trigrams(data, offsets)
                slots = memory.slots(code)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                for k in np.flatnonzero(np.diff(edges)) if len(p.languages) else ():
                    n = np.bincount(slots[edges[k]:edges[k + 1]])
                    some = np.flatnonzero(n)
                    bundle = n[some].astype(np.float32) @ memory.rows[some].astype(np.float32)
                    size = np.sqrt(bundle @ bundle)
                    if size > 0:
                        near = p.vectors @ bundle / size
                        best[begin + k] = near.argmax()
                        score[begin + k] = min(1.0, max(0.0, near.max()))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_judged", judge(F.col(text_col).cast("string"))).select(*rest, "_judged.lang_pred", "_judged.score")
