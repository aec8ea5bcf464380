"""Documents to packed training sequences: five stages, each over all that the one before it kept.

The first four return the columns of documents; the last returns the placed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dedup, packing, quality_model, secrets
from tessera.llm.common import discard, stored
from tessera.llm.tokens import tokenizer_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    judged = quality_model.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicate(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows."""
    found = secrets.scan(docs)
    cleaned = found.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("spans"))))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret redaction", redact_secrets),
    ("best-fit packing", pack),
]

#: The classifier, the signatures and the tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not read:
            discard(before)
    return docs
