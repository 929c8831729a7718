"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run() writes
each result as Parquet in the shared folder and reads it again. All stages but the last return
the columns of documents. A null text counts as empty in every stage, a null language or source is one of its own, rows
without an id stay rows of their own, of repeated rows the exact stage leaves one, and an empty table gives an
empty result; columns beside those of documents travel along until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, jaccard_join, language_model, mixing, packing
from quire.llm.common import materialise

NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the model of trusted text is within their language's quantile."""
    classifier = language_model.fit(docs, language_model.trusted_ids(spark, sf_dir))
    return language_model.classify(docs, classifier).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, the one with the largest id."""
    return exact_dedup.remove_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id."""
    return jaccard_join.remove_near_duplicates(docs, k=NEAR_WORDS, threshold=NEAR_SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights of their sources take them, shuffled inside output shards."""
    return mixing.mix(docs, places=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixture), ("packing", packed)]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages of run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
