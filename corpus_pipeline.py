"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and rereads for the next one.
All but the last keep the columns of documents.
An empty table gives an empty result, other columns than those of documents are dropped at the first stage, and nulls
stand for empty texts; what each stage does with ties and repeated rows is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, jaccard, packing, quality, secrets
from tracewright.llm.common import checked, rows_bound, settle, table
from tracewright.llm.spans import SPAN_BYTES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go: of empty and short texts all, of very long ones those that the rules reject as a whole."""
    return quality.filtered(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest doc_id (without one only if none has any), of repeated rows the first. Rows without words link with nothing and stay."""
    rows = numbered(docs)
    linked = settle(jaccard.link(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "pipeline-linked")
    several = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = settle(linked.join(several, "component_id").join(rows.select("row", "doc_id"), "row"), "pipeline-groups")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return kept(rows, members.join(first, "component_id").where("row <> first.row").select("row"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, with or without a doc_id."""
    rows = numbered(docs)
    found = decontam.contained(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return kept(rows, found.select(F.col("doc_id").alias("row")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; findings meet texts by content, so every row of a text gets them."""
    found = secrets.scan(docs).withColumn("secrets", F.concat("base", "added")).where(F.size("secrets") > 0)
    found = settle(found.select("blob", "secrets").dropDuplicates(["blob"]), "secrets")
    held = docs.select(*COLUMNS).withColumn("blob", secrets.blob_of("text"))
    out = held.join(checked(found, 160 + SPAN_BYTES * F.size("secrets")), "blob", "left")
    some = F.col("secrets").isNotNull()
    out = out.withColumn("text", F.when(some, secrets.redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; an empty text is a separator alone."""
    return packing.pack(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, so that rows without a doc_id and rows that share one are judged each.

    Numbers follow from how files are dealt to tasks, which changes with the cores that are there, so they are written with their rows, once a stage.
    """
    return settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")


def kept(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """rows without the rejected row numbers, which are broadcast up to a checked size."""
    rejected = settle(rejected.distinct(), "rejected")
    return rows.join(F.broadcast(rejected) if rows_bound(rejected, 1_000_000) else rejected, "row", "left_anti").select(*COLUMNS)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: Learned rules, components and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares the rows of run() with a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
