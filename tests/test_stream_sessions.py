"""Sessions folded batch by batch equal sessionize over the whole, however the lines are cut into batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import TRANSCRIPT, call, result
from tracewright.operators.records import upsert
from tracewright.operators.sessionize import sessionize
from tracewright.plans import table_sessions
from tracewright.sources.transcripts import parse
from tracewright.streaming.sessions import session_counts

SCHEMA = "session_id string, line_no long, line string"
#: A message whose first line tells a tier and comes last, calls that share an id, a result before its call.
ODD = [
    {"type": "assistant", "timestamp": "2026-01-02T11:00:00Z", "message": {"id": "x", "usage": {"output_tokens": 5}, "content": [{"type": "tool_use", "name": "Write", "id": "d"}]}},
    {"type": "assistant", "timestamp": "2026-01-02T11:00:01Z", "message": {"id": "x", "usage": {"output_tokens": 9, "service_tier": "priority"}, "content": [{"type": "text", "text": "a" * 3990}]}},
    result(1, "d", toolUseResult={"file": {"content": "x\ny"}}),
    call(2, "Bash", "d"),
    result(3, "d", toolUseResult={"structuredPatch": [{"lines": ["+a", "-b", "-c"]}]}),
    result(4, "late", toolUseResult={"structuredPatch": [{"lines": ["+a"]}], "userModified": True}),
    call(5, "Edit", "late"),
    result(6, "late", toolUseResult={"structuredPatch": [{"lines": ["+a"]}], "userModified": True}),
    {"type": "assistant", "message": {"id": "y", "content": [{"type": "text", "text": "b" * 30}, {"type": "text", "text": "c"}]}},
    {"type": "user", "message": {"content": "This session is being continued from a previous conversation"}},
]


def run(spark, tmp_path, batches):
    """The last row of each session after the batches, one file each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = (
        session_counts(parse(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return upsert(spark.read.parquet(out), "session_id", "lines").drop("lines")


def plain(df):
    return sorted((sorted(r.asDict(recursive=True).items()) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_any_split(spark, tmp_path, seed):
    rows = [(s, i, json.dumps(x)) for s, t in (("0a1b", TRANSCRIPT), ("odd", ODD), ("", TRANSCRIPT[:3])) for i, x in enumerate(t)]
    rows += [("0a1b", 90, "{not json"), ("none", 0, json.dumps({"type": "summary"})), ("torn", 0, "null")]
    whole = sessionize(parse(spark.createDataFrame(rows, SCHEMA)))
    if seed:
        random.Random(seed).shuffle(rows)
    cuts = [rows[i::4] for i in range(4)] if seed == 2 else [rows[:9], rows[9:10], rows[10:]]
    got = run(spark, tmp_path, cuts)
    assert plain(got) == plain(whole.select(got.columns)) and got.count() == 4


def test_tables(spark, tmp_path):
    """Transcripts of conversations and events, lines dealt to batches by hash."""
    lines = table_sessions.json_rows(spark, "/root/testdata/sf0.001").select("session_id", F.col("line_no").cast("long"), "line")
    for i in range(2):
        lines.where(F.abs(F.xxhash64("line")) % 2 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    got = run(spark, tmp_path, [])
    assert plain(got) == plain(sessionize(parse(lines)).select(got.columns))
