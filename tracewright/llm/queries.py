"""The queries of the training-data operators, by the names the driver knows, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import automata, decontam, jaccard, langid, lmscore, packing, pii, prefixes, quality, repair, secrets, suffix, toxicity
from tracewright.llm.common import table


def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.digest(langid.predict(docs, langid.fit(docs)))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.deduplicate(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.digest(rows, repair.plans(rows))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.digest(automata.deduplicate(table(spark, sf_dir, "documents")))


QUERIES = (op1_contextual_pii, op2_crf_language_id, op3_benchmark_decontamination, op4_toxic_segments, op5_best_fit_packing, op6_quality_rules, op7_stupid_backoff, op8_suffix_array_dedup, op9_ngram_jaccard_join, op10_secret_scans, op11_conversation_trie, op12_structure_repair, op13_substring_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": decontam.ORACLE, "op11_conversation_trie": prefixes.ORACLE, "op12_structure_repair": repair.ORACLE, "op13_substring_dedup": automata.ORACLE}
