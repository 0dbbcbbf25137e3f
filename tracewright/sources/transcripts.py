"""Transcripts: JSON lines of sessions, one file each, as ordered tables of lines and blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.regex import java


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the semantics of transcripts need: UTC, and the last of repeated keys in JSON."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def is_subagent_path(path: str | Column) -> Column:
    return F.col(path).rlike(r"[/\\]subagents[/\\]") if isinstance(path, str) else path.rlike(r"[/\\]subagents[/\\]")


def is_own_classifier_path(path: str | Column, tool_dir: str) -> Column:
    """Whether a path, raw or with dashes for what is not alphanumeric, lies in the folder that the classifier's own sessions run in."""
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike(rf"[-./\\]{tool_dir}[-/\\]classify")


def session_of(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)$", 1), r"\.jsonl\z", "")


def read_files(spark: SparkSession, root: str, *, tool_dir: str = "tool") -> DataFrame:
    """path and raw text of every *.jsonl below root that is no subagent's and not the classifier's own."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return files.where(~is_subagent_path("path") & ~is_own_classifier_path("path", tool_dir))


def read_lines(spark: SparkSession, root: str | list[str], *, tool_dir: str = "tool") -> DataFrame:
    """session_id, path, line_no and line of the files that read_files gives (or of the files named), cut into as many tasks as their bytes ask for.

    A line's place is where its piece of the file starts and its number in that reading of the piece, so places are
    ordered like the lines, though their values change with the pieces.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth")).alias("line_no"), F.col("value").alias("line"))
    return rows.where(~is_subagent_path("path") & ~is_own_classifier_path("path", tool_dir)).select(session_of("path").alias("session_id"), "path", "line_no", "line")


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """path, session_id, ended_at (when the file last changed), from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    return files.select("path", session_of("path").alias("session_id"), F.col("modificationTime").alias("ended_at")).where(~is_subagent_path("path"))


def below(spark: SparkSession, root: str) -> Callable[[str | Column], Column]:
    """path -> what of a file's path lies below root, decoded."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")

    def inside(path: str | Column) -> Column:
        c = F.col(path) if isinstance(path, str) else path
        own = F.url_decode(F.regexp_replace(F.regexp_replace(c, r"^[a-z0-9+.-]+:(?://[^/]*)?", ""), r"\+", "%2B"))
        return F.when(own.startswith(full + "/"), F.substring(own, F.lit(len(full) + 2), F.length(own))).otherwise(own)

    return inside


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """session_id, line_no and parsed JSON ``v`` of every line that is an object (or any other truthy value)."""
    rows = files.select(session_of("path").alias("session_id"), *keep, F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    return parse(rows)


def parse(rows: DataFrame) -> DataFrame:
    """rows with line (JSON text) -> rows with v; lines that do not parse, or are null, false, 0 or '', go.

    What is parsed is tested inside an array that is unfolded: a filter on v would be pushed below what makes it, and each test would write and parse the line anew.
    """
    kept = F.filter(F.array(F.try_parse_json("line")), lambda v: v.isNotNull() & _truthy(v))
    return rows.select(*(c for c in rows.columns if c != "line"), F.explode(kept).alias("v"))


def _truthy(v: Column) -> Column:
    """Whether a variant is neither null, false, 0 nor ''. Only what is no object is written out as text."""
    object_ = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return ~F.is_variant_null(v) & (object_ | ~F.to_json(v).isin("null", "false", "0", '""', "0.0"))


def text_of(v: str | Column, path: str) -> Column:
    """A string at a path; null if there is none or it is empty. Numbers become text, objects do not count."""
    c = F.col(v) if isinstance(v, str) else v
    return F.nullif(F.try_variant_get(c, path, "string"), F.lit(""))


def number_of(v: str | Column, path: str) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.try_variant_get(c, path, "long"), F.lit(0))


def array_of(v: str | Column, path: str) -> Column:
    """An array at a path; null if what is there is none."""
    c = F.col(v) if isinstance(v, str) else v
    return F.try_variant_get(c, path, "array<variant>")


def kind_of(v: str | Column, path: str) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.schema_of_variant(F.variant_get(c, path, "variant"))


def truthy(v: str | Column, path: str) -> Column:
    """Whether what is at a path is there and neither null, false, 0 nor ''."""
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce(_truthy(F.variant_get(c, path, "variant")), F.lit(False))


def is_string(v: str | Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path) == "STRING", F.lit(False))


#: Bytes of a ledger that a machine reads back.
LEDGER_TAIL = 2 << 20
LEDGER_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("ts", "session_id", "kind", "level", "category", "classifier", "activity_category", "domain", "message")] + [T.StructField("cost_usd", T.DoubleType())])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries with their order in the file; torn lines go."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return rows.select("file", "line_no", F.from_json("line", LEDGER_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("file", "line_no", "e.*").where("kind is not null")


def read_ledger_tail(spark: SparkSession, path: str, most: int = LEDGER_TAIL) -> DataFrame:
    """Entries of one ledger file as read_ledger gives them, from its last ``most`` bytes alone; a line torn by the cut goes. None without a file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    body = b""
    if fs.exists(at):
        size = fs.getFileStatus(at).getLen()
        stream = fs.open(at)
        try:
            stream.seek(max(0, size - most))
            body = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
    rows = [(path, i, x) for i, x in enumerate(body.decode("utf-8", "replace").split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, line string").select("file", "line_no", F.from_json("line", LEDGER_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("file", "line_no", "e.*").where("kind is not null")


def code_pattern() -> str:
    from tracewright.functions import vocab

    return "|".join(f"(?:{java(p)})" for p in vocab.HAS_CODE)
