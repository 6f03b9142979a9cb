"""Toxicity of a text: boosted trees over a dozen dense features, calibrated by isotonic regression.

The features are densities of a lexicon (general insults, and the words and word beginnings that labelled rows show to be
toxic), how close its words stand to the second person, capitals, punctuation and signs of obfuscation (letters set apart or
replaced by look-alikes).  They are computed over whole texts, by byte and by word, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm import textops as T
from seqrec.llm.ship import ship
from seqrec.session import cut

# General insults, and words of the second person in four languages.
INSULTS = ("bastard", "clown", "coward", "creep", "crap", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
           "liar", "loser", "lunatic", "maggot", "moron", "parasite", "pathetic", "pig", "psycho", "rat", "scum", "scumbag", "stupid", "trash",
           "ugly", "vermin", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "ye", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein",
                 "deine", "ihr", "euch", "tú", "ti", "tus", "usted", "ustedes", "vosotros")

#: Letters of a word beginning in the lexicon, written with a * after them.
STEM = 5

FEATURES = ("stem_density", "stem_words", "lexicon_density", "lexicon_words", "hidden_density", "near_second_person", "second_person_density", "lexicon_in_window",
            "capitals", "capital_words", "exclamations", "questions", "repeated_marks", "mixed_words", "log_words")

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LOOKS = T.LOWER.copy()
for _sign, _letter in zip(b"013457@$", b"oieastas"):
    _LOOKS[_sign] = _letter
_LOOK_SIGN = np.zeros(256, bool)
_LOOK_SIGN[list(b"013457@$")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\t\n\x0b\x0c\r ")] = True


def _hashes(words) -> np.ndarray:
    column = pa.array(list(words), pa.string())
    out = [T.span_hashes(data, *T.word_spans(data, offsets)[:2]) for _, data, offsets in T.text_chunks(column)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _reduced(data, offsets, table, keep):
    """Hashes of the words and of their beginnings, of the text with only the bytes in `keep` mapped by `table`; each row's first word."""
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=held[1:])
    data, offsets = table[data[keep]], held[offsets]
    starts, ends, first = T.word_spans(data, offsets)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    after = np.append(lead, len(data))[np.minimum(np.searchsorted(lead, starts) + STEM, len(lead))]
    return T.span_hashes(data, starts, ends), T.span_hashes(data, starts, np.minimum(after, ends)), first


def _per(count, n):
    return np.divide(count, n, out=np.zeros(len(n)), where=n > 0)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, stems: np.ndarray, second: np.ndarray, near: int = 3, window: int = 20) -> np.ndarray:
    """One row of FEATURES for each text of a chunk; a text without words has zeros."""
    letter = _LETTERS[data]
    plain, begins, first = _reduced(data, offsets, T.LOWER, letter | _BLANK[data])
    looks, _, first_l = _reduced(data, offsets, _LOOKS, letter | _BLANK[data] | _LOOK_SIGN[data])
    n = np.diff(first)
    stemmed = T.row_sums(np.isin(begins, stems).astype(np.int64), first)
    hit, hit_l, you = np.isin(plain, lexicon), np.isin(looks, lexicon), np.isin(plain, second)
    hits, hits_l = T.row_sums(hit.astype(np.int64), first), T.row_sums(hit_l.astype(np.int64), first_l)
    row = np.repeat(np.arange(len(n)), n)
    at, of = np.flatnonzero(hit), np.flatnonzero(you)
    beside = np.zeros(len(at), bool)
    if len(of):
        right = np.searchsorted(of, at)
        for k in (np.minimum(right, len(of) - 1), np.maximum(right - 1, 0)):
            beside |= (np.abs(of[k] - at) <= near) & (row[of[k]] == row[at])
    dense = np.zeros(len(n))
    np.maximum.at(dense, row[at], np.searchsorted(at, np.minimum(at + window, first[1:][row[at]])) - np.arange(len(at)))
    starts, ends, first_w = T.word_spans(data, offsets)
    words = np.diff(first_w)

    def rows(mark):
        held = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=held[1:])
        return held[offsets[1:]] - held[offsets[:-1]], held[ends] - held[starts]

    capital = (data >= 65) & (data <= 90)
    mark = (data == 33) | (data == 63)
    twice = mark.copy()
    twice[1:] &= mark[:-1]
    letters, letters_w = rows(letter)
    capitals, capitals_w = rows(capital)
    signs_w = rows(_LOOK_SIGN[data] | (data == 42))[1]
    by_word = lambda x: T.row_sums(x.astype(np.int64), first_w)
    return np.column_stack([
        _per(stemmed, n), np.log1p(stemmed),
        _per(np.maximum(hits, hits_l), n), np.log1p(np.maximum(hits, hits_l)), _per(np.maximum(hits_l - hits, 0), n),
        np.log1p(np.bincount(row[at], beside, len(n))), _per(np.bincount(row[of], minlength=len(n)), n), dense,
        _per(capitals, letters), _per(by_word((letters_w > 1) & (capitals_w == letters_w)), words),
        _per(rows(data == 33)[0], words), _per(rows(data == 63)[0], words), _per(rows(twice)[0], words),
        _per(by_word((letters_w > 0) & (signs_w > 0)), words), np.log1p(words)])


def learned_lexicon(labelled: DataFrame, most: int = 500, least_share: float = 0.01, ratio: float = 6.0) -> list[str]:
    """Words, and word beginnings marked with *, that stand out in toxic texts, the most frequent first, at most `most`.

    labelled has text and label 0/1; equal texts with one label count once.  A term qualifies if at least `least_share`
    of the toxic texts (5 at least) hold it and its mean share of a toxic text's words is `ratio` times that of the others'.
    """
    texts = labelled.dropDuplicates(["text", "label"]).withColumn("id", F.xxhash64("text", "label"))
    totals = texts.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).head()
    toxic, other = totals["toxic"] or 0, totals["other"] or 0
    if not toxic or not other:
        return []
    cleaned = F.regexp_replace(F.lower("text"), r"[^\p{L}\x20\x09-\x0D]+", "")
    words = F.filter(F.split(cleaned, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = texts.select("id", "label", words.alias("words")).where(F.size("words") > 0).select("id", "label", (F.lit(1.0) / F.size("words")).alias("part"), F.explode("words").alias("word"))
    terms = words.select("id", "label", "part", F.explode(F.array("word", F.concat(F.substring("word", 1, STEM), F.lit("*")))).alias("term"))
    held = terms.groupBy("id", "label", "term").agg(F.sum("part").alias("part"))
    counts = held.groupBy("term").agg(F.sum("label").alias("texts"), F.sum(F.col("part") * F.col("label")).alias("bad"), F.sum(F.col("part") * (1 - F.col("label"))).alias("good"))
    chosen = counts.where((F.col("texts") >= max(5, least_share * toxic)) & (F.col("bad") / toxic >= ratio * F.col("good") / other))
    return [r["term"] for r in chosen.orderBy(F.desc("texts"), "term").limit(most).collect()]


def with_features(docs: DataFrame, lexicon: list[str], text_col: str = "text") -> DataFrame:
    """docs with `features` in place of the text column."""
    ship(docs.sparkSession)
    terms = _hashes(w for w in lexicon if not w.endswith("*"))
    stems, second = _hashes(w[:-1] for w in lexicon if w.endswith("*")), _hashes(SECOND_PERSON)

    @F.arrow_udf("array<double>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [features(data, offsets, terms, stems, second) for _, data, offsets in T.text_chunks(column)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), flat)

    return docs.withColumn("features", judge(F.col(text_col).cast("string"))).drop(text_col)


@dataclass(frozen=True)
class Model:
    """Lexicon, trees and calibration; base is the score without trees."""

    lexicon: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def fit(labelled: DataFrame, sample: int = 20_000, rounds: int = 20, depth: int = 3, seed: int = 3) -> Model:
    """Learns from (doc_id, text, label 0/1); at most about `sample` rows, taken by the hash of doc_id.

    Four fifths of them grow the trees, the rest calibrates.  Rows with a null label or text are left out.  If only one class
    is there, the model is its share (0.5 without rows).
    """
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).where("text is not null and label in (0, 1)")
    n = labelled.count()
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000_000))
    labelled = cut(labelled.where(F.coalesce(key, F.lit(0)) < int(1_000_000_000 * min(1.0, sample / max(1, n)))), "labelled")
    lexicon = sorted({*INSULTS, *learned_lexicon(labelled)})
    rows = with_features(labelled, lexicon).withColumn("x", array_to_vector("features")).withColumn("y", F.col("label").cast("double"))
    rows = cut(rows.select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0).alias("later")), "features")
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = (seen.get(1.0, 0) + 1) / (sum(seen.values()) + 2)
    early = {r["y"] for r in rows.where("not later").select("y").distinct().collect()}
    if len(early) < 2:
        return Model(lexicon, None, None, base)
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(rows.where("not later"))
    judged = trees.transform(rows.where("later")).select(vector_to_array("probability")[1].alias("p"), "y")
    calibration = None
    if len({r["y"] for r in judged.select("y").distinct().collect()}) == 2:
        calibration = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="score").fit(judged)
    return Model(lexicon, trees, calibration, base)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1) and predicted (score >= 0.5); null texts count as empty.

    Existing columns named score or predicted are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    if model.trees is None:
        scored = docs.select(*rest, F.lit(model.base).alias("score"))
    else:
        packed = docs.select(F.struct(*rest).alias("_row"), F.col(text_col).alias("_text"))
        judged = model.trees.transform(with_features(packed, model.lexicon, "_text").select("_row", array_to_vector("features").alias("x")))
        judged = judged.select("_row", vector_to_array("probability")[1].alias("p"))
        scored = judged.withColumnRenamed("p", "score") if model.calibration is None else model.calibration.transform(judged)
        scored = scored.select("_row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
