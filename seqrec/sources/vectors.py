"""Item vectors: Parquet store for trained embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """Persist ``(item_id, vector ARRAY<DOUBLE>)`` so it can be reloaded / retrained."""
    vectors.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``embeddings`` table as ``(item_id, vector)``; ``vec_id`` is the item."""
    from pyspark.sql import functions as F
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("bigint").alias("item_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
