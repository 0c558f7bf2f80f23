"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, conversation_repair, decontaminate, language_id, license_scan, merkle_manifest, mixing, quality_model,
    quality_rules, secret_scan, simhash, sql, substring_dedup, weighted_sampling,
)
from .common import crc_part, documents, table

SIMHASH_SHINGLE, SIMHASH_BITS = 4, 4
QUALITY_POLICY = "v2"
REPEAT_WORDS = 35


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


#: Parameters of the one tool that chat turns call.
REPLY_SCHEMA = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("reply", "n_chars", "integer", False)]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call or result of ``conversations``."""
    calls, results = chat_format.exchanges(table(spark, sf_dir, "conversations"))
    values = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in REPLY_SCHEMA)
    schemas = spark.sql(f"select * from values {values} as t(name, parameter, type, required)")
    return chat_format.linked_calls(calls, results, schemas)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), SIMHASH_SHINGLE, SIMHASH_BITS)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), short_items=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", *(f"measures.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes(QUALITY_POLICY).alias("kept"), "fail_mask")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False))
    scores = quality_model.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), REPEAT_WORDS).drop("kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.checked(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.with_successor(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_chat_format, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_quality_rules,
    op6_quality_classifier, op7_license_scan, op8_secret_scan, op9_source_mixing, op10_substring_dedup,
    op11_merkle_manifest, op12_conversation_repair, op13_document_fingerprints,
)}

ORACLE: dict[str, str] = {
    "op2_chat_format": sql.CHAT_FORMAT,
    "op5_quality_rules": sql.quality_rules(QUALITY_POLICY),
    "op9_source_mixing": sql.source_mixing(),
    "op10_substring_dedup": sql.substring_dedup(REPEAT_WORDS),
    "op11_merkle_manifest": sql.MERKLE_MANIFEST,
    "op12_conversation_repair": sql.CONVERSATION_REPAIR,
}
