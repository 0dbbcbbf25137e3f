"""Operator 10, secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds the findings of each
(blob, rule version) pair that was ever scanned; only pairs it lacks are scanned, one text for each blob
however many paths hold it, and findings are read from the ledger and joined back to all paths.

Defined results: a null or empty text is the empty blob and has no findings. A null path is returned as such,
and repeated rows each get their own row. A new rule version makes every pair unseen. Other columns than the
path and text are never read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import checked, own_path, settle, texts
from tracewright.llm.spans import SPAN_BYTES, Kind, count_of, flat, joined, with_spans

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: {24,} and {16,} take the same whole runs as + with a test of the length, without a match at every letter.
BASE = (
    Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, "rlike(text, '[:=]')"),
    Kind("access", r"AKIA[A-Z0-9]{16,}", sign="contains(text, 'AKIA')"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", sign="contains(text, '-----BEGIN ')"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", sign="contains(text, 'eyJ')"),
    Kind("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]{1,64}:[^\s:@/]{1,128}@", sign="contains(text, '://')"),
)
#: Of the patterns as they stand: a changed one makes every pair unseen.
RULES_VERSION = "rules-" + hashlib.sha256(repr([(k.name, k.pattern) for k in (*BASE, *MORE)]).encode()).hexdigest()[:12]
LEDGER_SCHEMA = "blob string, rules string, base array<struct<kind:string,start:int,stop:int>>, added array<struct<kind:string,start:int,stop:int>>"


def scan_texts(df: DataFrame, base: tuple[Kind, ...] = BASE, more: tuple[Kind, ...] = MORE) -> DataFrame:
    """df with base and added, from its column text."""
    return with_spans(df, (*base, *more)).withColumns({"base": flat(base, by_start=True), "added": flat(more, by_start=True)})


def blob_of(text: str) -> Column:
    """The content address of a text; of an empty one for null."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)


def blobs(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("blob", blob_of("text"))


def read_ledger(spark: SparkSession, ledger: str, rules: str) -> DataFrame:
    """Findings of the pairs of a rule version, one row a blob; none where the ledger does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rules") == rules)


def scan(docs: DataFrame, *, ledger: str | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """doc_id, blob, base and added of every row.

    What the ledger (a Parquet folder; one of this run's own in the shared folder if none is named) lacks is
    scanned and appended to it; findings of all paths are then read from the ledger. Blobs of earlier runs that no
    path holds now are left out before anything is shuffled by blob but their addresses.
    """
    spark = docs.sparkSession
    ledger = ledger or own_path(spark, "secret-ledger")
    held = blobs(docs)
    paths = settle(held.select("doc_id", "blob"), "secret-paths")
    wanted = paths.groupBy("blob").agg(F.min("doc_id").alias("reader"))
    unseen = wanted.join(read_ledger(spark, ledger, rules).select("blob"), "blob", "left_anti")
    one = held.alias("h").join(unseen.alias("u"), (F.col("h.blob") == F.col("u.blob")) & F.col("h.doc_id").eqNullSafe(F.col("u.reader"))).select("h.blob", "h.text")
    new = scan_texts(one).select("blob", F.lit(rules).alias("rules"), "base", "added")
    new.write.mode("append").option("compression", "zstd").parquet(ledger)
    known = read_ledger(spark, ledger, rules).where("size(base) + size(added) > 0")
    known = settle(known.join(wanted.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]), "secret-known")
    out = paths.join(checked(known, 160 + SPAN_BYTES * F.size(F.concat("base", "added"))), "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return out.select("doc_id", "blob", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def digest(found: DataFrame, base: tuple[Kind, ...] = BASE, more: tuple[Kind, ...] = MORE) -> DataFrame:
    """The contract's columns."""
    counts = {f"n_{k.name}": count_of("base", k.name) for k in base}
    place = F.create_map(*(x for i, k in enumerate((*base, *more)) for x in (F.lit(k.name), F.lit(i))))
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("a"), place[s["kind"]].alias("b"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    every = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["stop"].alias("stop")))
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with what its spans cover, overlaps merged, replaced by a mark."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    tail = F.aggregate(ordered, zero, step)
    return F.when(F.size(spans) > 0, F.concat(tail["out"], F.substring(text, tail["at"] + 1, F.length(text)))).otherwise(text)
