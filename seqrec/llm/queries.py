"""The registered queries opN_<name>: thin, over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm import (classlm, langid, minhash, mixing, multiindex, multiprobe, packing, quality, residentlloyd, secrets, toxicity, whitening,
                        wrappers)
from seqrec.llm.sql import SQL  # noqa: F401  (registered beside the queries)
from seqrec.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(mod: int):
    """crc32 of doc_id as text, modulo mod."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicate texts of every document: doc_id, class_id, kept."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))["classes"]


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with cosine >= 0.95 of every vector: vec_id, n_links, component_id, kept."""
    return multiindex.near_vectors(_table(spark, sf_dir, "embeddings"), target_recall=1.0)


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a class-based bigram model learned from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classlm.fit(docs.where(F.coalesce(_remainder(7) != 2, F.lit(True))))
    scored = classlm.score(docs.withColumn("held_out", F.coalesce(_remainder(7) == 2, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    pages = _table(spark, sf_dir, "pages")
    texts = wrappers.extract(pages, cut(wrappers.infer(pages), "wrappers"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdict of every document, with counts of its whole text."""
    docs = quality.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them: doc_id, held_out, lang_pred, score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    profiles = langid.fit(docs.where(_remainder(3) != 1))
    return langid.predict(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), derive={"ids_crc32": F.crc32}, ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base rules' spans, and all spans as text."""
    paths = secrets.scan(_table(spark, sf_dir, "documents"))["paths"]
    number = lambda no: F.size(F.filter("spans", lambda s: s["rule_no"] == no)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rule_no"] < len(secrets.BASE))
    return paths.select("doc_id", *[number(no).alias(f"n_{r.kind}") for no, r in enumerate(secrets.BASE)],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones: doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.where(_remainder(5) != 0).join(labels, "doc_id"))
    return toxicity.score(docs.withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False))), model)


#: Shares of the tokens that mixing aims at, by what the labels say of a document.
MIX = {"good": 0.94, "low": 0.04, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else low or good quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).where("domain is not null")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document for the target weights: doc_id, n_tokens, its posterior of each domain, rate."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = mixing.mix(docs, docs.join(domain_labels(spark, sf_dir), "doc_id"), MIX)
    return made["rates"].select("doc_id", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(made["domains"])], "rate")


#: Labels up to which their sums are broadcast; beyond, Spark joins them.
FEW_LABELS = 10_000


def op11_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector: vec_id, code, error, label_error, codebooks_sha256."""
    made = residentlloyd.compress(_table(spark, sf_dir, "embeddings"), keep=("label",))
    digits = ",".join(str(v) for book in made["codebooks"] for v in book.reshape(-1))
    codes = made["codes"].select("vec_id", F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "").alias("code"), "error", F.col("kept.label").alias("label"))
    codes = cut(codes, "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("bigint").alias("label_error"))
    sums = cut(sums.withColumnRenamed("label", "of"), "label_sums")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return (codes.join(sums, codes["label"].eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(digits.encode()).hexdigest()).alias("codebooks_sha256")))


def op12_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product found for every vec_id divisible by 20: query_id, rank, vec_id, score."""
    return multiprobe.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    explained = [float(e) / model["trace"] for e in model["eigenvalues"]] if model else []
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"] if model else 0).cast("bigint").alias("n"), F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
                       F.array(*[F.lit(e) for e in explained]).cast("array<double>")[F.col("at")].alias("explained"), F.lit(model["identity_error"] if model else 0.0).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_multi_index, op3_class_lm, op4_wrappers, op5_quality, op6_language, op7_packing, op8_secrets, op9_toxicity, op10_mixing, op11_resident_lloyd,
                                   op12_multiprobe, op13_whitening)}
