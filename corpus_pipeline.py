"""A training corpus from documents: quality, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import jaccard, packing, quality, secretscan, shared, toxicity
from netquarry.llm.queries import site, table

#: No SQL: trained classifiers and a tokenizer take part. tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose posterior quality is below one half."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return quality.keep_good(docs, model, "text", *site(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxic passage."""
    model = toxicity.train(*toxicity.sample_labelled(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", zeros=1800, ones=900))
    return toxicity.keep_clean(docs, model, "text")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8."""
    found = jaccard.join(docs, "doc_id", "text", n=5, percent=80)
    gone = found.where(F.col("component") != F.col("key")).select(F.col("key").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret span; n_chars follows the new text."""
    out = secretscan.redact(docs, "text")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences with the CRC-32 of their ids."""
    pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=0)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", distinct), ("secrets", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    folder = f"{shared.folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
