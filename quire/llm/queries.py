"""The opN_ queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, content_store, covering, exact_dedup, jaccard_join, language_model, line_dedup, minhash, mixing, packing, prefix_trie, sharding, toxicity
from .common import new_path, text_of

SHARDS, SHARD_SEED = 8, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "store")
    content_store.write_store(table(spark, sf_dir, "documents"), root)
    return content_store.read_store(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_of(docs)
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard_rows(rows, SHARDS, ["doc_id", "text_crc32"], SHARD_SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    classifier = language_model.fit(docs, language_model.trusted_ids(spark, sf_dir))
    return language_model.classify(docs, classifier).drop("text")


def held_out(doc_id):
    """The fifth of rows that labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.mark_exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(table(spark, sf_dir, "documents"), k=4, threshold=0.85)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), shards.alias("shards"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.simhash_classes(table(spark, sf_dir, "documents"), k=4, radius=4, seed=42)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), group=20, most=4)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dimensions=64, scale=1024, seed=3)


QUERIES = {"op1_packing": op1_packing, "op2_content_store": op2_content_store, "op3_line_dedup": op3_line_dedup, "op4_sharding": op4_sharding, "op5_quality_classifier": op5_quality_classifier, "op6_toxicity": op6_toxicity, "op7_exact_dedup": op7_exact_dedup, "op8_minhash": op8_minhash, "op9_jaccard_join": op9_jaccard_join, "op10_mixing": op10_mixing, "op11_simhash_near_dedup": op11_simhash_near_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_centroid_clustering": op13_centroid_clustering}
