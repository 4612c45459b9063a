"""The opN_ queries: each applies one operator to its whole table and returns the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_engine.llm import block_names, fingerprint, html_text, mixing, near_dedup, packing, quality_model, quality_rules, ranked_search, sharding, token_counts, toxicity

from drift_engine.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tokens_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


def op4_fingerprint_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op6_mix_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + F.col("part")).alias("taken"))


def op7_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_near_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", "evidence")


def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_exact_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_names.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_search_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pack_patterns, op2_quality_bayes, op3_tokens_by_section, op4_fingerprint_multiset, op5_html_suffix_array, op6_mix_waterfill, op7_shard_hilbert, op8_near_hyperminhash, op9_toxicity_neighbours, op10_quality_lines, op11_exact_block_names, op12_search_maxscore)}

__all__ = ["ORACLES", "QUERIES"]
