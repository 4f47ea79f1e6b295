"""A training-corpus pipeline: each stage reads all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, with the columns of ``documents`` in all stages but the last. ``run`` writes
each stage as Parquet in the shared folder and rereads it for the next one, so lost
executors repeat one stage at most. No SQL expresses the learnt and hashed stages, so
ORACLE_SQL is None; tests/llm/test_pipeline.py compares each stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import decontamination, frames, near_duplicates, pieces, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.good(docs, quality.fit(docs, labels.where(frames.remainder("doc_id", 5) != 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows the text."""
    out = secrets.mask(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded): token ids of each text, and the text that they decode to."""
    coded = pieces.round_trip(docs.select("doc_id", "text"), pieces.model_bytes()).drop("text")
    return coded.select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = frames.written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
