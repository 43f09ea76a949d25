"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html_text, mixing, neardup, oracles, quality, secret_scan, sharding, substrings, suffixes
from .shared import load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(load(spark, sf_dir, "documents"))
    spans = F.col("findings")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] < secret_scan.BASE)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.render(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.render(spans).alias("spans"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(load(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.withColumn("topic", mixing.topic(F.col("text"))), targets=mixing.TARGETS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ann.search(vectors, vectors.filter("id % 50 = 0").select("id"), k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    held = F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_substring_dedup, op4_secret_scan, op5_minhash, op6_sharding, op7_mixing, op8_neighbours, op9_suffix_dedup, op10_quality)}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op3_substring_dedup": oracles.SUBSTRINGS,
    "op4_secret_scan": oracles.SECRETS,
    "op5_minhash": oracles.NEAR_DUPLICATES,
    "op6_sharding": oracles.SHARDING,
    "op8_neighbours": oracles.NEIGHBOURS,
    "op9_suffix_dedup": oracles.SUFFIXES,
}
