"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but packing return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm import langid, minhash, mixing, packing, secrets
from seqrec.llm.queries import MIX, domain_labels, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without a letter (or without a text) go.

    The profiles are learned from the rows with a language; lang itself stays what it was.
    """
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("_row"), "text"), langid.fit(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least doc_id.

    Rows that repeat a kept doc_id are one document, of which one row stays; rows without a doc_id stay.
    """
    kept = minhash.near_duplicates(docs)["classes"].where("kept and doc_id is not null").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by [kind], and n_chars (if there) is the new text's length."""
    clean = secrets.redact(docs, secrets.scan(docs)["paths"])
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probability of their rate, decided by the hash of doc_id.

    Rates lie between 0 and 1 and the total is free, so that the kept tokens have the shares of the targets and most documents of the
    domain that is short of its share stay; posteriors are calibrated on held-out labels, since the shares are met as the posteriors tell.
    """
    columns = docs.columns
    made = mixing.mix(docs.select("doc_id", "text"), docs.select("doc_id", "text").join(domain_labels(spark, sf_dir), "doc_id"), MIX, subset=True, calibrate=True)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    gone = made["rates"].where("doc_id is not null").where(F.col("rate") <= chance).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.pack(docs, vocabulary(), derive={"ids_crc32": F.crc32}, ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
