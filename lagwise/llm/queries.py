"""The queries opN_<name>, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, language_id, lm_scoring, packing, quality_rules, simhash_dedup, suffix_dedup, toxicity, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return url_filters.classify(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn and tool call of conversations, linked to its answer, ordered, validated, as canonical JSON."""
    calls, results = chat_format.turns_as_calls(table(spark, sf_dir, "conversations"))
    return chat_format.link(calls, results, chat_format.TURN_SCHEMA).drop("level")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document."""
    out = quality_rules.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_format, op3_quality_rules, op4_language_id, op5_best_fit_packing, op6_decontamination, op7_suffix_dedup, op8_simhash_dedup, op9_lm_scoring, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat_format.SQL, "op3_quality_rules": quality_rules.SQL, "op4_language_id": language_id.SQL, "op7_suffix_dedup": suffix_dedup.SQL}
