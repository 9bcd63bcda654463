"""The registered queries of the operators: whole tables, production parameters, thin digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, license_rules, mixing, near_dedup, period_runs, pitman_yor, preference, quality_mil,
               secret_scan, topk, toxicity, whitening)
from .common import crc_remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spans(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.swapped_answer_pairs(_read(spark, sf_dir, "conversations"))
    return preference.format_preferences(pairs).select(
        "pair_id", "prompt_turns", "prompt", "chosen", "rejected",
        _spans("chosen_spans").alias("chosen_mask"), _spans("rejected_spans").alias("rejected_mask"))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    remainder = crc_remainder(F.col("doc_id"), 3)
    model = quality_mil.train_quality(docs, _read(spark, sf_dir, "labels"), remainder != 1)
    scored = docs.select("doc_id", (remainder == 1).alias("held_out"), quality_mil.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans")


def op4_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc_remainder(F.col("doc_id"), 4)
    model = toxicity.train_toxicity(docs, _read(spark, sf_dir, "labels"), remainder != 2)
    scored = model.score(docs).select("doc_id", (remainder == 2).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_read(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 7) == 2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_copies(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten, by its id's checksum, goes round in some of its own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", mixing.word_count(F.col("text")).alias("n"), h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("first", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.col("g") % 8))
    round_ = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    return rows.select("doc_id", F.when(round_, period_runs.looped(F.col("text"), F.col("first"), period)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(_planted(_read(spark, sf_dir, "documents"))).withColumn("top", period_runs.longest_run("runs"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    length, period = F.col("top.length"), -F.col("top.minus_period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.minus_start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_preference_format, op2_quality_mil, op3_secret_links, op4_toxicity_gbt, op5_decontamination,
                            op6_pitman_yor, op7_exact_dedup, op8_source_mix, op9_license_rules, op10_near_dedup,
                            op11_whitening, op12_top_products, op13_periodic_runs)}
