"""The gate: 58 fields, one coercion each, and telemetry of what was coerced.

The dictionary below is the schema. Gate expressions, the record's type and the documentation come from it, so
they cannot drift apart. Anything else in an input row is dropped, since the output is selected field by field.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.regex import java
from tracewright.functions.scalars import MAX_INT, clamp01, clamp_int, iso_minute, iso_text, non_negative
from tracewright.functions.text import matches, scrub


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    known: tuple[str, ...] = ()
    default: str | None = None
    cap: int = MAX_INT
    shape: str = ""


FACT = "struct<k:string,v_num:double,v_str:string>"
DICTIONARY = (
    Field("claude_session_id", "id", shape=V.SESSION_ID, cap=80), Field("project_label", "label", shape=V.PROJECT_LABEL), Field("started_at", "time"), Field("ended_at", "time"),
    Field("duration_s", "int"), Field("turn_count", "int"), Field("token_total", "int"),
    Field("activity_category", "enum", V.ACTIVITY_CATEGORIES, "other"), Field("domain", "enum", V.DOMAINS, "other"), Field("intent_summary", "composed"),
    Field("tools_used", "tools", V.BUILTIN_TOOLS), Field("techniques", "enums", V.TECHNIQUES), Field("mcp_tool_count", "int", cap=500), Field("mcp_tool_hashes", "hashes", cap=V.MCP_CAP),
    Field("error_rate", "unit"), Field("rework_score", "unit"), Field("friction_score", "unit"), Field("outcome", "enum", V.OUTCOMES, "unknown"), Field("outcome_score", "unit"),
    Field("friction_reasons", "enums", V.FRICTION_REASONS), Field("satisfaction", "enum", V.SATISFACTIONS, "unknown"),
    Field("input_tokens", "int"), Field("cache_read_tokens", "int"), Field("cache_creation_tokens", "int"), Field("cache_hit_ratio", "unit"), Field("est_cost_usd", "usd"), Field("service_tier", "enum", V.SERVICE_TIERS, "unknown"),
    Field("lines_added", "int"), Field("lines_removed", "int"), Field("commits", "int"), Field("user_edit_rate", "unit"), Field("model", "model", shape=V.MODEL, cap=60),
    Field("denials", "int", cap=1000), Field("denial_rate", "unit"), Field("interruptions", "int", cap=1000), Field("frustration_score", "unit"),
    Field("prompt_antipatterns", "enums", V.PROMPT_ANTIPATTERNS), Field("prompt_quality", "unit"), Field("is_continuation", "bool"), Field("compactions", "int", cap=1000),
    Field("subagent_types", "hashes", cap=V.SUBAGENTS_CAP), Field("max_parallel_tools", "int", cap=100), Field("permission_mode", "enum", V.PERMISSION_MODES, "unknown"), Field("nudges_shown", "enums", V.COACH_NUDGES),
    Field("git_analyzed", "bool"), Field("survival_rate", "unit_or_null"), Field("lines_surviving", "int"), Field("lines_superseded", "int"), Field("reverts", "int", cap=1000), Field("git_analyzed_at", "instant"),
    Field("classifier", "enum", V.CLASSIFIERS, "deterministic"), Field("extractor_version", "version", shape=V.LABEL), Field("trust_tier", "enum", V.TRUST_TIERS, "self_reported"), Field("classify_cost_usd", "usd"),
    Field("session_facts", "facts"), Field("region_counts", "regions", V.REGION_KEYS, cap=V.REGION_CAP), Field("region_taxonomy", "taxonomy"), Field("schema_version", "schema", cap=99),
)
TYPES = {"int": "bigint", "unit": "double", "unit_or_null": "double", "usd": "double", "bool": "boolean", "time": "timestamp", "instant": "timestamp", "tools": "array<string>", "enums": "array<string>", "hashes": "array<string>", "schema": "bigint", "facts": f"array<{FACT}>", "regions": "struct<" + ",".join(f"{k}:bigint" for k in V.REGION_KEYS) + ">"}
SCHEMA = ", ".join(f"{f.name} {TYPES.get(f.kind, 'string')}" for f in DICTIONARY)
EVENT = "struct<field:string,reason:string>"


def _event(field: str, reason: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))


def _provided(x: Column) -> Column:
    return F.coalesce(x.cast("string") != "", F.lit(False))


def _shaped(f: Field, raw: Column) -> Column:
    s = F.coalesce(raw.cast("string"), F.lit(""))
    if f.kind in ("id", "model"):
        s = F.lower(F.left(s, F.lit(f.cap)))
    return F.when(s.rlike(java(f.shape)), s).otherwise("")


def _facts(raw: Column) -> Column:
    """Known keys at their first place with their last value, numbers as such, texts scrubbed and then cut; blank ones go."""
    tidy = F.transform(raw, lambda e: F.struct(e["k"].alias("k"), e["v_num"].alias("v_num"), F.when(e["v_num"].isNull() & e["v_str"].isNotNull(), F.left(scrub(e["v_str"]), F.lit(V.FACT_CAP))).alias("v_str")))
    good = F.filter(tidy, lambda e: e["k"].isin(*V.FACT_KEYS) & (e["v_num"].isNotNull() | (F.coalesce(e["v_str"], F.lit("")) != "")))
    keys = F.array_distinct(F.transform(good, lambda e: e["k"]))
    return F.slice(F.transform(keys, lambda k: F.element_at(F.filter(good, lambda e: e["k"] == k), -1)), F.lit(1), F.lit(V.FACTS_CAP))


def _times(now: Column) -> dict[str, Column]:
    late = now + F.expr(f"interval {V.SKEW_MINUTES} minutes")
    started = iso_minute(F.col("started_at").cast("string"))
    started = F.when(started <= late, started)
    ended = iso_minute(F.col("ended_at").cast("string"))
    return {"started_at": started, "ended_at": F.when((ended <= late) & (started.isNull() | (ended >= started)), ended)}


def coerced_fields(now: Column) -> dict[str, Column]:
    """First pass: a column for each field but those that follow from others."""
    out = _times(now)
    for f in DICTIONARY:
        raw = F.col(f.name)
        if f.kind == "int":
            out[f.name] = clamp_int(raw, f.cap)
        elif f.kind == "unit":
            out[f.name] = clamp01(raw)
        elif f.kind == "unit_or_null":
            out[f.name] = F.when(raw.isNotNull(), clamp01(raw))
        elif f.kind == "usd":
            out[f.name] = non_negative(raw)
        elif f.kind == "bool":
            out[f.name] = F.coalesce(raw.cast("boolean"), F.lit(False))
        elif f.kind == "enum":
            out[f.name] = F.when(raw.isin(*f.known), raw).otherwise(f.default)
        elif f.kind in ("id", "label", "model", "version"):
            out[f.name] = _shaped(f, raw)
        elif f.kind == "tools":
            names = F.filter(F.coalesce(raw, F.array()), lambda t: t.isNotNull())
            out[f.name] = F.array_distinct(F.transform(names, lambda t: F.when(t.isin(*V.BUILTIN_TOOLS), t).otherwise("other_tool")))
        elif f.kind == "enums":
            out[f.name] = _members(raw, f.known)
        elif f.kind == "hashes":
            out[f.name] = F.slice(_hashes(raw), F.lit(1), F.lit(f.cap))
        elif f.kind == "facts":
            out[f.name] = _facts(F.coalesce(raw, F.array().cast(f"array<{FACT}>")))
        elif f.kind == "regions":
            out[f.name] = F.struct(*(clamp_int(raw[k], f.cap).alias(k) for k in f.known))
        elif f.kind == "taxonomy":
            out[f.name] = F.lit(V.REGION_TAXONOMY)
        elif f.kind == "schema":
            out[f.name] = F.coalesce(F.nullif(clamp_int(raw, f.cap), F.lit(0)), F.lit(3))
        elif f.kind == "instant":
            out[f.name] = F.try_to_timestamp(raw.cast("string"))
    return out


def _members(raw: Column, known: tuple[str, ...]) -> Column:
    return F.filter(F.array_distinct(F.coalesce(raw, F.array())), lambda x: x.isin(*known))


def _hashes(raw: Column) -> Column:
    return F.filter(F.array_distinct(F.coalesce(raw, F.array())), lambda x: x.rlike(java(V.HASH12)))


def coercions(now: Column) -> Column:
    """Events (field, reason): once for each wrong value that was given, for each distinct value that an array lost, for each null tool, for a start long ago."""
    one = []
    many = []
    for f in DICTIONARY:
        raw = F.col(f.name)
        if f.kind == "enum":
            one.append(F.when(_provided(raw) & ~raw.isin(*f.known), _event(f.name, "enum_fallback")))
        elif f.kind in ("id", "label", "model", "version"):
            one.append(F.when(_provided(raw) & (_shaped(f, raw) == ""), _event(f.name, "shape_rejected")))
        elif f.kind in ("enums", "hashes"):
            good = _members(raw, f.known) if f.kind == "enums" else _hashes(raw)
            many.append(F.array_repeat(_event(f.name, "array_value_dropped"), F.size(F.array_distinct(F.coalesce(raw, F.array()))) - F.size(good)))
        elif f.kind == "tools":
            many.append(F.array_repeat(_event(f.name, "array_value_dropped"), F.size(F.filter(F.coalesce(raw, F.array()), lambda t: t.isNull()))))
    one.append(F.when(_times(now)["started_at"] < now - F.expr(f"interval {V.STALE_DAYS} days"), _event("started_at", "stale_started_at")))
    return F.concat(F.array_compact(F.array(*one)), *many)


def _standard(s: Column) -> Column:
    """Whether a text has a shape that any field may have."""
    words = sorted({w for f in DICTIONARY for w in f.known} | set(V.FACT_KEYS))
    shapes = (V.SESSION_ID, V.HASH12, V.LABEL, V.MODEL, V.ISO_MINUTE, V.COMPOSED_INTENT)
    out = s.isin(*words, V.REGION_TAXONOMY, "")
    for p in shapes:
        out = out | s.rlike(java(p))
    return out


def structural(df: DataFrame, *, compat: bool = False) -> DataFrame:
    """Second pass: texts of no known shape become '' and are told. With compat, git_analyzed_at is a text that must fall on a minute."""
    events, out = [], {}
    for f in DICTIONARY:
        c = F.col(f.name)
        if TYPES.get(f.kind, "string") == "string":
            good = _standard(c)
            out[f.name] = F.when(good, c).otherwise("")
            events.append(F.when(~good, F.array(_event(f.name, "shape"))).otherwise(F.array().cast(f"array<{EVENT}>")))
        elif f.kind in ("tools", "enums", "hashes"):
            out[f.name] = F.transform(c, lambda x: F.when(_standard(x), x).otherwise(""))
            events.append(F.array_repeat(_event(f.name, "shape"), F.size(F.filter(c, lambda x: ~_standard(x)))))
        elif f.kind == "facts":
            good = lambda v: v.isNull() | _standard(v) | matches(v, V.FACT_VALUE)
            out[f.name] = F.transform(c, lambda e: F.struct(e["k"].alias("k"), e["v_num"].alias("v_num"), F.when(good(e["v_str"]), e["v_str"]).otherwise("").alias("v_str")))
            events.append(F.array_repeat(_event("session_facts.v", "shape"), F.size(F.filter(c, lambda e: ~good(e["v_str"])))))
    if compat:
        minute = F.date_trunc("MINUTE", "git_analyzed_at") == F.col("git_analyzed_at")
        events.append(F.when(~minute, F.array(_event("git_analyzed_at", "shape"))).otherwise(F.array().cast(f"array<{EVENT}>")))
        out["git_analyzed_at"] = F.when(minute, iso_text("git_analyzed_at")).when(F.col("git_analyzed_at").isNotNull(), "")
    return df.withColumns(out | {"coerced": F.concat("coerced", *events)})


def enforce(raw: DataFrame, now: datetime | Column, *, compat: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 58 fields of the record in order, and ``coerced``. Fields that raw lacks are absent ones; ``keep`` passes columns of raw through."""
    moment = F.lit(now) if isinstance(now, datetime) else now
    missing = {f.name: F.lit(None).cast(_input_type(f)) for f in DICTIONARY if f.name not in raw.columns}
    rows = raw.withColumns(missing) if missing else raw
    fields = coerced_fields(moment)
    rows = rows.select(*keep, coercions(moment).alias("coerced"), *(fields[f.name].alias(f.name) for f in DICTIONARY if f.name in fields))
    rows = rows.withColumn("intent_summary", F.concat("activity_category", F.lit(" · "), "domain"))
    return structural(rows, compat=compat).select(*keep, *(f.name for f in DICTIONARY), "coerced")


def _input_type(f: Field) -> str:
    return "string" if f.kind in ("time", "instant", "schema") or TYPES.get(f.kind, "string") == "string" else TYPES[f.kind]


def validate(raw: DataFrame, now: datetime | Column) -> tuple[DataFrame, DataFrame]:
    """Accepted records and rejected rows: a record needs an id and a start."""
    out = enforce(raw, now)
    good = (F.col("claude_session_id") != "") & F.col("started_at").isNotNull()
    return out.where(good), out.where(~good)


def noisy_senders(gated: DataFrame) -> DataFrame:
    """Coercion events by field and reason."""
    return gated.select(F.explode("coerced").alias("e")).groupBy("e.field", "e.reason").agg(F.count("*").alias("n"))


def documentation() -> str:
    """The dictionary as a Markdown table."""
    rows = "\n".join(f"| `{f.name}` | {f.kind} | {', '.join(f.known) or f.shape.replace('|', chr(92) + '|')} |" for f in DICTIONARY)
    return f"| field | kind | values or shape |\n|---|---|---|\n{rows}\n"
