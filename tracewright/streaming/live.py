"""The live side: brain events of transcript lines, throttled nudges, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.functions import vocab as V
from tracewright.functions.scalars import block_tokens, describe_tool, region_of, text_tokens
from tracewright.functions.text import has_code, trim
from tracewright.operators.records import upsert
from tracewright.sources.transcripts import array_of, number_of, parse, text_of, truthy

EVENT = "struct<region:string,tokens:long,task:string,tool:string>"


def _event(region: Column | str, tokens: Column, task: Column | str, tool: Column | None = None) -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(c(region).alias("region"), tokens.cast("long").alias("tokens"), c(task).alias("task"), (F.lit(None).cast("string") if tool is None else tool).alias("tool"))


def brain_events(rows: DataFrame, agent: Column, now: Column | None = None) -> DataFrame:
    """agent, region, tokens, task, tool, ts of lines (line: JSON text): none to many a line, from assistant lines alone.

    Stateless, so it serves files and streams alike.
    """
    v = parse(rows.withColumn("agent", agent)).where((text_of("v", "$.type") == "assistant") & truthy("v", "$.message"))
    blocks = F.filter(F.coalesce(array_of("v", "$.message.content"), F.array().cast("array<variant>")), lambda b: ~F.is_variant_null(b))
    counted = F.size(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin("tool_use", "text", "thinking")))
    ts = F.coalesce(text_of("v", "$.timestamp"), now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    d = v.select("agent", ts.alias("ts"), block_tokens(number_of("v", "$.message.usage.output_tokens"), counted).alias("each"), F.explode(blocks).alias("b"))
    d = d.select("agent", "ts", "each", "b", text_of("b", "$.type").alias("kind"), text_of("b", "$.name").alias("name"), trim(F.coalesce(text_of("b", "$.text"), F.lit(""))).alias("text"), F.coalesce(text_of("b", "$.thinking"), F.lit("")).alias("thinking"))
    said = F.concat(
        F.array(F.when(has_code("text"), _event("broca", text_tokens("text"), "Generating code")).otherwise(_event("wernicke", text_tokens("text"), "Composing response"))),
        F.when(F.length("text") > 280, F.array(_event("prefrontal", text_tokens("text", 10), "Reasoning through approach"))).otherwise(F.array().cast(f"array<{EVENT}>")),
    )
    events = (
        F.when(F.col("kind") == "tool_use", F.array(_event(region_of("name"), F.col("each"), describe_tool("name", lambda k: text_of("b", f"$.input.{k}")), F.col("name"))))
        .when((F.col("kind") == "text") & (F.col("text") != ""), said)
        .when(F.col("kind") == "thinking", F.array(_event("prefrontal", text_tokens("thinking", 4, 20), "Extended thinking")))
    )
    return d.select("agent", "ts", F.explode(events).alias("e")).select("agent", "e.*", "ts")


class Throttle(StatefulProcessor):
    """State of a key: when its last event was logged."""

    minutes = V.THROTTLE_MINUTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = pd.concat([r["ts"] for r in rows]).dropna().sort_values()
        held, gap, out = self.last.get(), pd.Timedelta(minutes=self.minutes), []
        last = pd.Timestamp(held[0]) if held else None
        for t in times:
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        if out:
            self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "kind": [key[1]] * len(out), "ts": out})

    def close(self) -> None:
        pass


def throttled(stream: DataFrame) -> DataFrame:
    """Nudges (session_id, kind, ts) that are logged, as a stream; needs the RocksDB state store."""
    return stream.groupBy("session_id", "kind").transformWithStateInPandas(Throttle(), "session_id string, kind string, ts timestamp", "append", "none")


def upsert_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what is stored and what came are merged, the last version of each key stays."""

    def merge(batch: DataFrame, _: int) -> None:
        held = read()
        write(upsert(batch if held is None else held.unionByName(batch), key, order))

    return merge
