"""A training-corpus pipeline over the documents table: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.functions import lineage
from cardamom.llm import byte_bpe, common, decontaminate, jaccard, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; null texts stay."""
    model = toxicity.fit_toxicity(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at 0.8 stays, the one with the smallest id."""
    return jaccard.keep_one_of_each(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows."""
    # scan_secrets replaces a column spans; one of docs is kept under another name.
    (own,) = common.fresh(docs, "_spans")
    kept = docs.withColumnRenamed("spans", own)
    clean = secret_scan.redact_secrets(secret_scan.scan_secrets(kept)).withColumnRenamed(own, "spans")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents.

    Each result goes to a folder of its own under the shared checkpoint folder, and is removed once the next one is written;
    the last one's stays, as the returned rows are read from it. Null texts stay to the end and have no tokens; a table
    without rows gives none; columns besides those of documents go through all stages but the last.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            lineage.remove(spark, f"{folder}/{k - 1}")
    return docs
