"""Records: assembly from sessions, upsert by session, re-survey queue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.scalars import region_of, ship_label
from tracewright.functions.text import hmac12
from tracewright.operators.gate import enforce


def mcp_split(used: Column, salt: str | None) -> tuple[Column, Column, Column]:
    """Names of tools that are not of a server, how many are, and their pseudonyms (none without a salt)."""
    servers = F.filter(used, lambda n: n.startswith("mcp__"))
    hashes = F.transform(servers, lambda n: hmac12(salt, n)) if salt else F.array().cast("array<string>")
    return F.filter(used, lambda n: ~n.startswith("mcp__")), F.size(servers), hashes


def region_counts(calls: Column, used: Column) -> Column:
    """Calls by region; distinct tools stand in where there are no calls."""
    names = F.when(F.size(calls) > 0, F.transform(calls, lambda t: t["name"])).otherwise(used)
    regions = F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), region_of)
    return F.struct(*(_count(regions, k).alias(k) for k in V.REGION_KEYS))


def _count(regions: Column, key: str) -> Column:
    return F.size(F.filter(regions, lambda r: r == key)).cast("long")


def build_records(labelled: DataFrame, now: datetime | Column, *, salt: str | None = None, labels: dict[str, str] | None = None, nudges: DataFrame | None = None, git: DataFrame | None = None, ship_facts: bool = True) -> DataFrame:
    """The gated record of every session (metrics, prompt quality and labels beside it)."""
    assigned = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("project_label")] if labels else None
    own, n_mcp, hashes = mcp_split(F.col("tools_used"), salt)
    s = labelled
    s = s.join(nudges, "session_id", "left") if nudges is not None else s.withColumn("nudges_shown", F.array().cast("array<string>"))
    if git is not None:
        g = git.select("session_id", F.lit(True).alias("git_analyzed"), "survival_rate", "lines_surviving", "lines_superseded", "reverts", F.lit(None).cast("timestamp").alias("git_analyzed_at") if "git_analyzed_at" not in git.columns else F.col("git_analyzed_at"))
        s = s.join(g, "session_id", "left").withColumns({"git_analyzed": F.coalesce("git_analyzed", F.lit(False)), "survival_rate": F.when(F.coalesce("git_analyzed", F.lit(False)), F.col("survival_rate")).otherwise(0.0)})
    else:
        s = s.withColumns({"git_analyzed": F.lit(False), "survival_rate": F.lit(0.0)})
    raw = s.withColumns({
        "claude_session_id": F.col("session_id"), "project_label": ship_label("project_label", salt, assigned),
        "region_counts": region_counts(F.col("tool_calls"), F.col("tools_used")), "tools_used": own, "mcp_tool_count": n_mcp, "mcp_tool_hashes": hashes,
        "subagent_types": F.transform("subagent_types", lambda t: hmac12(salt, t)) if salt else F.array().cast("array<string>"),
        "session_facts": F.col("facts") if ship_facts else F.array().cast("array<struct<k:string,v_num:double,v_str:string>>"),
        "trust_tier": F.lit("self_reported"), "schema_version": F.lit("4"),
    })
    return enforce(raw, now)


def upsert(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def upsert_by_field(rows: DataFrame, key: str, order: str, keep: tuple[str, ...]) -> DataFrame:
    """Like upsert, but fields in ``keep`` hold their last value that is not null, so that a poorer version does not wipe them."""
    others = [c for c in rows.columns if c not in (key, order, *keep)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return rows.groupBy(key).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in others), *(last(c).alias(c) for c in keep))


def survey_queue(sessions: DataFrame, surveyed: DataFrame, now: datetime | Column, *, days: tuple[int, int] = V.SURVEY_DAYS, most: int = 3) -> DataFrame:
    """Sessions (session_id, ended_at) that ended 7 to 30 days ago and are not in the ledger, oldest first."""
    moment = F.lit(now) if isinstance(now, datetime) else now
    day = lambda n: F.expr(f"interval {n} days")
    due = sessions.where(F.col("ended_at").between(moment - day(days[1]), moment - day(days[0])))
    return due.join(surveyed.select("session_id").distinct(), "session_id", "left_anti").orderBy("ended_at", "session_id").limit(most)


def verdict_bucket(verdict: Column) -> Column:
    """Extension: win, partial or loss by a verdict's whole first word, else null."""
    word = F.lower(F.regexp_extract(verdict, r"^([A-Za-z]+)(?![A-Za-z0-9_])", 1))
    return F.when(word.isin("win", "partial", "loss"), word)
