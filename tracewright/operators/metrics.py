"""Deterministic metrics of sessions, and the aggregates behind them over plain event tables.

``session_metrics`` works on session rows with arrays. The other functions are the same measures as partial
aggregates over an event table (session_id, ord, kind, name, is_error, file_path, text), for sessions of any
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.scalars import estimate_cost, round3
from tracewright.functions.text import Text, col, count_where, counted, jaccard, let, listed, matches, word_set


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def error_rate(errors: Column, results: Column, calls: Column) -> Column:
    return unit(errors / F.coalesce(F.nullif(results, F.lit(0)), F.nullif(calls, F.lit(0)), F.lit(1)))


def error_factor(errors: Column, results: Column) -> Column:
    return F.least(F.lit(1.0), errors / F.greatest(F.lit(3.0), results * 0.15))


def rework(most_edits: Column) -> Column:
    return unit((most_edits - 2) / 5)


def outcome_score(passed: Column, failed: Column, summary: Column, shipped: Column, error: Column, rework_: Column, factor: Column, user_edits: Column, denials: Column, frustration: Column) -> Column:
    """Terms in a fixed order: thresholds are compared with the unrounded sum."""
    s = F.lit(0.5) + F.when(passed & ~failed, 0.20).otherwise(0.0) + F.when(summary, 0.10).otherwise(0.0) + F.when(shipped, 0.10).otherwise(0.0)
    s = s - F.lit(0.30) * error - F.lit(0.15) * rework_ - F.lit(0.15) * factor - F.lit(0.15) * user_edits
    return unit(s - F.lit(0.10) * F.least(F.lit(1.0), denials / 2) - F.lit(0.10) * frustration)


def outcome(score: Column, abandoned: Column, evidence: Column) -> Column:
    return F.when(abandoned, "abandoned").when(score < 0.45, "failed").when(score < 0.75, F.when(evidence, "partial").otherwise("unknown")).otherwise("success")


def friction_score(error: Column, factor: Column, rework_: Column, frustration: Column) -> Column:
    return unit(F.lit(0.40) * error + F.lit(0.25) * factor + F.lit(0.15) * rework_ + F.lit(0.20) * frustration)


def frustration_score(repeats: Column, sweary: Column, shouting: Column, interruptions: Column, denials: Column) -> Column:
    part = lambda w, n, k: F.lit(w) * F.least(F.lit(1.0), n / k)
    return round3(unit(part(0.30, repeats, 2) + part(0.25, sweary, 2) + part(0.15, shouting, 1) + part(0.15, interruptions, 2) + part(0.15, denials, 2)))


def is_shouting(text: Text) -> Column:
    only = F.regexp_replace(col(text), "[^A-Za-z]", "")
    return (F.length(only) >= 12) & (only == F.upper(only))


def repeated_prompts(prompts: Column) -> Column:
    """Neighbouring prompts of twelve characters or more that are alike."""
    rows = F.transform(prompts, lambda p: F.struct(F.length(p).alias("n"), word_set(p).alias("w")))
    rest = F.greatest(F.size(prompts) - 1, F.lit(0))
    pairs = let(rows, lambda r: F.zip_with(F.slice(r, F.lit(1), rest), F.slice(r, F.lit(2), rest), lambda a, b: (a["n"] >= 12) & (b["n"] >= 12) & (jaccard(a["w"], b["w"]) >= 0.6)))
    return count_where(pairs, lambda x: x)


def test_state(text: Text, is_error: Text) -> Column:
    """fail, pass or null of one result; a failure wins over a pass."""
    return F.when(col(is_error) | matches(text, V.TEST_FAIL), "fail").when(matches(text, V.TEST_PASS), "pass")


def most_of_one(paths: Column) -> Column:
    """How often the most frequent path occurs."""
    return F.coalesce(F.array_max(F.transform(counted(paths), lambda p: p["n"])), F.lit(0))


def techniques(used: Column, thinking_chars: Column, thinking_blocks: Column, parallel: Column) -> Column:
    has = lambda *names: F.arrays_overlap(used, F.array(*map(F.lit, names)))
    return listed([
        (has("ExitPlanMode", "exit_plan_mode"), "plan_mode"),
        (has("Task", "Agent"), "subagents"),
        (has("SlashCommand", "Skill"), "skills"),
        (F.exists(used, lambda n: n.startswith("mcp__")), "mcp_tools"),
        (has("TodoWrite", "TaskCreate", "TaskUpdate"), "todo_tracking"),
        (has("WebSearch", "WebFetch"), "web_research"),
        ((thinking_chars > 200) | (thinking_blocks >= 3), "extended_thinking"),
        (parallel >= 2, "parallel_tools"),
    ])


def friction_reasons(errors: Column, factor: Column, tests_failed: Column, rework_: Column, outcome_: Column, denials: Column, frustration: Column, most_reads: Column, thinking_chars: Column, calls: Column) -> Column:
    return listed([
        ((errors >= 3) & (factor >= 0.6), "repeated_errors"), (tests_failed, "build_test_failures"), (rework_ >= 0.5, "high_rework"), (outcome_ == "abandoned", "abandoned_after_error"),
        (denials >= 2, "tool_denials"), (frustration >= 0.5, "user_frustration"), (most_reads >= 4, "context_thrash"), ((thinking_chars > 3000) & (calls < 3), "long_thinking_low_action"),
    ])


def satisfaction(frustration: Column, last_two: Column, denials: Column, interruptions: Column) -> Column:
    return (
        F.when(frustration >= 0.5, "negative").when(last_two == "", "unknown").when(matches(last_two, V.NEG_SENTIMENT), "negative").when(matches(last_two, V.POS_SENTIMENT), "positive")
        .when((denials >= 2) | (interruptions >= 2), "negative").otherwise("neutral")
    )


def last_texts(texts: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(texts, F.greatest(F.size(texts) - (n - 1), F.lit(1)), F.lit(n)), " ")


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Sessions with metrics beside them, one projection after the other so that nothing is worked out twice."""
    c = F.col
    s = sessions.withColumns({
        "n_calls": F.size("tool_calls"),
        "most_edits": most_of_one(F.transform(F.filter("tool_calls", lambda t: t["name"].isin(*V.EDIT_TOOLS) & (t["file_path"] != "")), lambda t: t["file_path"])),
        "most_reads": most_of_one(F.transform(F.filter("tool_calls", lambda t: t["name"].isin("Read", "NotebookRead") & (t["file_path"] != "")), lambda t: t["file_path"])),
        "last_event": F.try_element_at(F.filter("events", lambda e: e["kind"] != "thinking"), F.lit(-1)),
        "frustration_score": frustration_score(repeated_prompts(c("prompt_texts")), count_where("prompt_texts", lambda p: matches(p, V.FRUSTRATION_WORDS)), count_where("prompt_texts", is_shouting), c("interruptions"), c("denials")),
    })
    s = s.withColumns({
        "error_rate_raw": error_rate(c("errors"), c("n_results"), c("n_calls")), "factor": error_factor(c("errors"), c("n_results")), "rework_raw": rework(c("most_edits")),
        "tests_passed": F.coalesce(c("last_test") == "pass", F.lit(False)), "tests_failed": F.coalesce(c("last_test") == "fail", F.lit(False)),
        "ends_with_summary": F.coalesce(c("last_event.kind") == "text", F.lit(False)), "shipped": (c("commits") > 0) | c("pushed"),
        "user_edit_raw": F.when(c("edit_results") > 0, unit(c("user_modified_edits") / c("edit_results"))).otherwise(0.0),
        "denial_raw": unit(c("denials") / F.coalesce(F.nullif("n_results", F.lit(0)), F.nullif("n_calls", F.lit(0)), F.lit(1))),
        "satisfaction": satisfaction(c("frustration_score"), last_texts(c("user_texts")), c("denials"), c("interruptions")),
    })
    s = s.withColumns({
        "abandoned": F.coalesce((c("last_event.kind") == "tool_result") & c("last_event.is_error"), F.lit(False)) | ((c("turn_count") <= 1) & (c("errors") > 0) & ~c("tests_passed")),
        "score": outcome_score(c("tests_passed"), c("tests_failed"), c("ends_with_summary"), c("shipped"), c("error_rate_raw"), c("rework_raw"), c("factor"), c("user_edit_raw"), c("denials"), c("frustration_score")),
        "evidence": (c("errors") > 0) | c("tests_passed") | c("tests_failed") | (c("rework_raw") > 0) | c("shipped") | (c("user_edit_raw") > 0) | (c("denials") > 0) | (c("interruptions") > 0) | (c("frustration_score") > 0) | c("satisfaction").isin("positive", "negative"),
    })
    s = s.withColumn("outcome", outcome(c("score"), c("abandoned"), c("evidence")))
    cached = c("cache_read_tokens") + c("cache_creation_tokens")
    s = s.withColumns({
        "error_rate": round3(c("error_rate_raw")), "rework_score": round3(c("rework_raw")), "outcome_score": round3(c("score")), "denial_rate": round3(c("denial_raw")), "user_edit_rate": round3(c("user_edit_raw")), "retry_loops": c("errors"),
        "friction_score": round3(friction_score(c("error_rate_raw"), c("factor"), c("rework_raw"), c("frustration_score"))),
        "friction_reasons": friction_reasons(*(c(n) for n in ("errors", "factor", "tests_failed", "rework_raw", "outcome", "denials", "frustration_score", "most_reads", "thinking_chars", "n_calls"))),
        "techniques": techniques(c("tools_used"), c("thinking_chars"), c("thinking_blocks"), c("max_parallel_tools")),
        "cache_hit_ratio": round3(F.when(cached > 0, c("cache_read_tokens") / cached).otherwise(0.0)),
        "est_cost_usd": estimate_cost("model", "input_tokens", "token_total", "cache_read_tokens", "cache_creation_tokens"),
    })
    return s.drop("last_test", "last_event", "error_rate_raw", "rework_raw", "user_edit_raw", "denial_raw", "abandoned", "score", "evidence", "n_calls", "n_results", "errors", "most_edits", "most_reads", "factor", "shipped", "ends_with_summary")


# Over event tables.


def event_summary(events: DataFrame) -> DataFrame:
    """Per session: calls, results, errors, last test state, last event that is not thinking, turns (texts)."""
    c = F.col
    e = events.withColumn("state", F.when(c("kind") == "tool_result", test_state(F.coalesce("text", F.lit("")), "is_error")))
    return e.groupBy("session_id").agg(
        F.count_if(c("kind") == "tool_use").alias("calls"), F.count_if(c("kind") == "tool_result").alias("results"), F.count_if((c("kind") == "tool_result") & c("is_error")).alias("errors"),
        F.max_by("state", F.when(c("state").isNotNull(), c("ord"))).alias("last_state"), F.coalesce(F.bool_or(c("state") == "fail"), F.lit(False)).alias("ever_failed"),
        F.max_by(F.struct("kind", "is_error"), F.when(c("kind") != "thinking", c("ord"))).alias("last_event"), F.count_if(c("kind") == "text").alias("turns"),
    )


def most_edits(events: DataFrame) -> DataFrame:
    """Per session: edits of the file with most of them. Two levels, so a busy session is counted before it meets."""
    edits = events.where((F.col("kind") == "tool_use") & F.col("name").isin(*V.EDIT_TOOLS) & (F.coalesce("file_path", F.lit("")) != ""))
    return edits.groupBy("session_id", "file_path").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.max("n").alias("most_edits"))


def event_outcomes(events: DataFrame) -> DataFrame:
    """Per session: error_rate, rework, score and outcome from structure alone."""
    c = F.col
    s = event_summary(events).join(most_edits(events), "session_id", "left").withColumn("most_edits", F.coalesce("most_edits", F.lit(0)))
    s = s.withColumns({"error_raw": error_rate(c("errors"), c("results"), c("calls")), "factor": error_factor(c("errors"), c("results")), "rework": rework(c("most_edits")), "passed": F.coalesce(c("last_state") == "pass", F.lit(False)), "failed": F.coalesce(c("last_state") == "fail", F.lit(False)), "summary": F.coalesce(c("last_event.kind") == "text", F.lit(False))})
    none = F.lit(0)
    s = s.withColumns({
        "score": outcome_score(c("passed"), c("failed"), c("summary"), F.lit(False), c("error_raw"), c("rework"), c("factor"), F.lit(0.0), none, F.lit(0.0)),
        "abandoned": F.coalesce((c("last_event.kind") == "tool_result") & c("last_event.is_error"), F.lit(False)) | ((c("turns") <= 1) & (c("errors") > 0) & ~c("passed")),
        "evidence": (c("errors") > 0) | c("passed") | c("failed") | (c("rework") > 0),
    })
    return s.withColumn("outcome", outcome(c("score"), c("abandoned"), c("evidence"))).withColumn("friction", friction_score(c("error_raw"), c("factor"), c("rework"), F.lit(0.0)))


def searches_before_edit(events: DataFrame) -> DataFrame:
    """Per session: search calls before the first edit, or all of them without one."""
    w = Window.partitionBy("session_id")
    first = F.min(F.when((F.col("kind") == "tool_use") & F.col("name").isin(*V.EDIT_TOOLS), F.col("ord"))).over(w)
    e = events.withColumn("first_edit", first)
    early = (F.col("kind") == "tool_use") & F.col("name").isin(*V.SEARCH_TOOLS) & (F.col("first_edit").isNull() | (F.col("ord") < F.col("first_edit")))
    return e.groupBy("session_id").agg(F.count_if(early).alias("searches"))


def tools_first_seen(events: DataFrame) -> DataFrame:
    first = events.where((F.col("kind") == "tool_use") & F.col("name").isNotNull()).groupBy("session_id", "name").agg(F.min("ord").alias("ord"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("tools"))


def consecutive_similarity(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Jaccard similarity of each text with the one before it in its session."""
    rows = turns.withColumn("w", word_set(text))
    before = F.lag("w").over(Window.partitionBy(session).orderBy(order))
    return rows.withColumn("before", before).where("before is not null").select(session, order, jaccard(F.col("before"), F.col("w")).alias("similarity"))


