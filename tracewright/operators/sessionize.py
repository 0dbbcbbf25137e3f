"""Sessions from transcript lines: an ordered fold of each session's lines, as aggregates that merge.

Lines are read once: each is unfolded to a row of its own and a row a block. One shuffle deals the lines of an assistant by
session and message (many lines repeat one message, the first counts), the blocks by session and call to find the call of a
result, and the rest spread; then rows are summed by session, a task what it has, and sums meet in order. So a session's lines
may lie in any number of tasks. Order is (line_no, block_no), the place in the file; line_no is whatever is ordered, a number
or a place (see read_lines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.text import has_code, matches, trim
from tracewright.operators.metrics import test_state
from tracewright.sources.transcripts import array_of, is_string, kind_of, number_of, text_of, truthy


def _last(value: str, order: str = "line_no") -> Column:
    """The last value that is not null, by order."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def _first(value: str, order: str = "line_no") -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def _ordered(value: Column | str, condition: Column, by: str = "ord") -> Column:
    """Values of the rows that meet a condition, in order."""
    v = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col(by).alias("o"), v.alias("x")))))
    return F.transform(rows, lambda r: r["x"])


def line_table(lines: DataFrame) -> DataFrame:
    """One row a line with what does not depend on its blocks."""
    d = lines.select(
        "session_id", "line_no", "v",
        text_of("v", "$.type").alias("type"), text_of("v", "$.subtype").alias("subtype"), text_of("v", "$.sessionId").alias("inner_id"), text_of("v", "$.timestamp").alias("ts"),
        text_of("v", "$.cwd").alias("cwd"), text_of("v", "$.gitBranch").alias("git_branch"), text_of("v", "$.permissionMode").alias("permission_mode"),
        truthy("v", "$.message").alias("has_message"), text_of("v", "$.message.id").alias("msg_id"), text_of("v", "$.message.model").alias("model"), text_of("v", "$.message.usage.service_tier").alias("service_tier"),
        F.coalesce(F.size(F.filter(array_of("v", "$.message.content"), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False)))), F.lit(0)).alias("n_calls"), *(("path",) if "path" in lines.columns else ()),
        *(number_of("v", f"$.message.usage.{k}").alias(k) for k in ("output_tokens", "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")),
    )
    return d.withColumns({
        "is_assistant": (F.col("type") == "assistant") & F.col("has_message"),
        "is_user": (F.col("type") == "user") & F.col("has_message"),
        "msg": F.coalesce("msg_id", F.concat(F.lit("anon-"), F.col("line_no").cast("string"))),
    })


def block_table(line: DataFrame, *, lines_too: bool = False) -> DataFrame:
    """One row a content block, and one for content that is a string; with lines_too one a line as well (is_line, block_no -1), which alone has what the line says."""
    text = F.array(F.parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("string"), F.lit("text"), F.try_variant_get("v", "$.message.content", "string")))))
    blocks = array_of("v", "$.message.content")
    content = F.when((F.col("is_assistant") | F.col("is_user")) & blocks.isNotNull(), blocks).when(F.col("is_user") & is_string("v", "$.message.content"), text)
    keep = []
    if lines_too:
        content = F.concat(F.array(F.lit(None).cast("variant")), F.coalesce(content, F.array().cast("array<variant>")))
        keep = [c for c in line.columns if c not in ("session_id", "line_no", "ts", "is_assistant", "is_user", "msg", "v")]
    d = line.select("session_id", "line_no", "ts", "is_assistant", "is_user", "msg", F.variant_get("v", "$.toolUseResult", "variant").alias("tool"), *keep, F.posexplode(content).alias("block_no", "b")).where(~F.is_variant_null("b"))
    if lines_too:
        d = d.withColumns({"block_no": F.col("block_no") - 1, "is_line": F.col("block_no") == 0} | {c: F.when(F.col("block_no") == 0, F.col(c)) for c in keep} | {"tool": F.when(F.col("block_no") > 0, F.col("tool"))})
    d = d.withColumns({"ord": F.struct("line_no", "block_no"), "kind": text_of("b", "$.type"), "name": text_of("b", "$.name"), "call_id": F.coalesce(text_of("b", "$.id"), text_of("b", "$.tool_use_id"))})
    return d.withColumns({
        "is_call": F.col("is_assistant") & (F.col("kind") == "tool_use"),
        "is_result": F.col("is_user") & (F.col("kind") == "tool_result"),
    })


def result_text(b: str = "b") -> Column:
    """A result's content: a string, or an array of strings and {text} joined by newlines."""
    each = F.transform(array_of(b, "$.content"), lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit(""))))
    return F.coalesce(F.when(is_string(b, "$.content"), F.try_variant_get(b, "$.content", "string")), F.array_join(each, "\n", ""), F.lit(""))


def told_blocks(blocks: DataFrame, typed_most: int | None = None) -> DataFrame:
    """Blocks with what each tells by itself, from whole texts; their JSON is read here and left behind. Stateless, so it serves files and streams alike. typed_most: characters that are kept of what a user typed."""
    shown = F.when(F.col("is_assistant") & (F.col("kind") == "text"), trim(F.coalesce(text_of("b", "$.text"), F.lit(""))))
    typed = F.when(F.col("is_user") & F.col("kind").isin("text", "string"), trim(F.coalesce(text_of("b", "$.text"), F.lit(""))))
    hunks = F.filter(F.flatten(F.transform(array_of("tool", "$.structuredPatch"), lambda h: F.coalesce(array_of(h, "$.lines"), F.array().cast("array<variant>")))), lambda x: F.schema_of_variant(x) == "STRING")
    signed = lambda sign: F.size(F.filter(hunks, lambda x: F.try_variant_get(x, "$", "string").startswith(sign)))
    d = blocks.withColumns({
        "file_path": F.when(F.col("is_call"), F.coalesce(*(text_of("b", f"$.input.{k}") for k in ("file_path", "notebook_path", "path")), F.lit(""))),
        "subagent": F.when(F.col("is_call") & F.col("name").isin("Task", "Agent") & is_string("b", "$.input.subagent_type"), F.left(F.try_variant_get("b", "$.input.subagent_type", "string"), F.lit(V.SUBAGENT_CAP))),
        "result": F.when(F.col("is_result"), result_text()),
        "is_error": F.when(F.col("is_result"), truthy("b", "$.is_error")),
        "shown": F.nullif(shown, F.lit("")),
        "typed": F.nullif(typed, F.lit("")),
        "thinking": F.when(F.col("is_assistant") & (F.col("kind") == "thinking"), F.length(F.coalesce(text_of("b", "$.thinking"), F.lit("")))),
        "noted": F.col("is_result") & kind_of("tool", "$").startswith("OBJECT"),
        "patched": F.coalesce(F.size(array_of("tool", "$.structuredPatch")), F.lit(0)) > 0,
        "written": F.when(is_string("tool", "$.file.content"), F.size(F.split(F.try_variant_get("tool", "$.file.content", "string"), "\n", -1))),
        "modified": truthy("tool", "$.userModified"),
        "commit": F.col("is_result") & truthy("tool", "$.gitOperation.commit"),
        "push": F.col("is_result") & truthy("tool", "$.gitOperation.push"),
    })
    injected = matches("typed", r"^\s*<") | matches("typed", r"^\s*Caveat:") | matches("typed", V.INTERRUPT)
    d = d.withColumns({
        "denied": matches("result", V.DENIAL), "test": F.when(F.col("is_result"), test_state("result", "is_error")),
        "added": F.when(F.col("noted") & F.col("patched"), signed("+")), "removed": F.when(F.col("noted") & F.col("patched"), signed("-")),
        "is_prompt": F.col("typed").isNotNull() & ~injected,
    }).drop("tool", "b")
    return d if typed_most is None else d.withColumn("typed", F.left("typed", F.lit(typed_most)))


USAGE = ("output_tokens", "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def told_lines(rows: DataFrame, window: Window) -> DataFrame:
    """Rows of lines with whether each is the first of an assistant's message, and the calls of the message so far. window: of session and message, in order."""
    turn = F.col("is_line") & F.col("is_assistant")
    return rows.withColumns({"is_turn": turn & (F.row_number().over(window) == 1), "calls": F.when(turn, F.sum("n_calls").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))})


def enriched_rows(rows: DataFrame, typed_most: int | None = None) -> DataFrame:
    """Lines as told_lines gives them, and blocks with what is derived from each, results with the name of the latest earlier call that has their id.

    Lines are dealt by session and message, blocks by session and call; lines and blocks of none are spread.
    """
    d = told_blocks(rows, typed_most)
    dealt = F.when(F.col("is_line") & F.col("is_assistant"), F.struct(F.lit(0).alias("of"), F.col("msg").alias("key"))).when(F.col("call_id").isNotNull(), F.struct(F.lit(1).alias("of"), F.col("call_id").alias("key")))
    by = Window.partitionBy("session_id", F.coalesce(dealt, F.struct(F.lit(2).alias("of"), F.concat_ws(" ", F.col("line_no").cast("string"), "block_no").alias("key")))).orderBy("ord", "service_tier", *USAGE)
    calls = by.rowsBetween(Window.unboundedPreceding, -1)
    call_name = F.last(F.when(F.col("is_call"), F.col("name")), ignorenulls=True).over(calls)
    d = told_lines(d, by).withColumn("result_name", F.when(F.col("is_result"), F.coalesce(F.when(F.col("call_id").isNotNull(), call_name), F.lit(""))))
    edit = F.col("noted") & F.col("result_name").isin(*V.EDIT_TOOLS)
    return d.withColumns({
        "is_edit": F.coalesce(edit, F.lit(False)),
        "lines_added": F.when(edit, F.coalesce("added", F.when(F.col("result_name") == "Write", F.col("written")), F.lit(0))),
        "lines_removed": F.when(edit, F.col("removed")),
        "user_modified": F.coalesce(edit & F.col("modified"), F.lit(False)),
        "event_kind": F.when(F.col("is_call"), "tool_use").when(F.col("is_result"), "tool_result").when(F.col("shown").isNotNull(), "text").when(F.col("thinking").isNotNull(), "thinking"),
    })


def first_of_message(session: str, message: str, *order: str | Column) -> Column:
    """Whether a row is the first of its message, which many lines can repeat."""
    return F.row_number().over(Window.partitionBy(session, message).orderBy(*order)) == 1


def calls_in_message(is_call: Column, session: str, message: str) -> Column:
    """How many calls a row's message holds."""
    return F.sum(is_call.cast("int")).over(Window.partitionBy(session, message))


def length_before(text: str, session: str, order: str) -> Column:
    """Characters of a session's texts before a row."""
    return F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def head_of(text: str, before: Column, most: int, condition: Column, by: str = "ord") -> Column:
    """The first characters of a group's texts joined by newlines, from rows that begin before the cut alone."""
    return F.left(F.array_join(_ordered(text, condition & (before < most), by), "\n"), F.lit(most))


def duration_s(started: Column, ended: Column) -> Column:
    """Whole seconds between two times, rounded; 0 where there is none or time runs backwards."""
    seconds = F.round((F.unix_millis(ended) - F.unix_millis(started)) / 1000)
    return F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0))).cast("long")


def first_user_text(prompts: Column, typed: Column) -> Column:
    return F.coalesce(F.get(prompts, F.lit(0)), F.get(typed, F.lit(0)), F.lit(""))


#: What a session keeps the last of (its first: inner_id, started_at), by the column of a line.
ENDS = {"inner_id": "inner_id", "started_at": "ts", "ended_at": "ts", "model": "model", "cwd": "cwd", "git_branch": "git_branch", "permission_mode": "permission_mode"}


def line_sums(columns: list[str]) -> list[Column]:
    """What a session's lines say, from rows of told_lines. Ends are kept with their places, so sums of any parts of a session add up."""
    c = F.col
    at = lambda x, on: F.when(on & x.isNotNull(), F.struct(c("line_no").alias("o"), x.alias("x")))
    end = lambda n: (F.min if n in ("inner_id", "started_at") else F.max)(at(c(ENDS[n]), c("is_line") & c("is_assistant") if n == "model" else c("is_line")))["x"]
    return [
        F.count_if("is_turn").alias("turn_count"), F.count_if(c("is_line") & (c("type") == "system") & F.lower("subtype").contains("compact")).alias("compactions"), F.coalesce(F.max("calls"), F.lit(0)).cast("long").alias("max_parallel_tools"),
        F.max(at(c("service_tier"), c("is_turn")))["x"].alias("service_tier"), *(end(n).alias(n) for n in ENDS), *((F.min("path").alias("path"),) if "path" in columns else ()),
        *(F.coalesce(F.sum(F.when(c("is_turn"), c(a))), F.lit(0)).alias(b) for a, b in zip(USAGE, ("token_total", "input_tokens", "cache_read_tokens", "cache_creation_tokens"))),
    ]


def _finished(s: DataFrame) -> DataFrame:
    """What follows from a session's lines alone."""
    blank = {n: F.coalesce(n, F.lit("")) for n in ("cwd", "git_branch", "permission_mode", "service_tier", "model")}
    return s.withColumns(blank | {
        "session_id": F.coalesce(F.nullif("session_id", F.lit("")), "inner_id", F.lit("")),
        "duration_s": duration_s(F.try_to_timestamp("started_at"), F.try_to_timestamp("ended_at")),
    })


def line_totals(lines: DataFrame) -> DataFrame:
    """One row a session of what its lines say, as sessionize has it; blocks are only counted."""
    line = line_table(lines).withColumn("is_line", F.lit(True)).drop("v")
    key = F.when(F.col("is_assistant"), F.struct(F.lit(0).alias("of"), F.col("msg").alias("key"))).otherwise(F.struct(F.lit(2).alias("of"), F.col("line_no").cast("string").alias("key")))
    told = told_lines(line, Window.partitionBy("session_id", key).orderBy("line_no", "service_tier", *USAGE))
    return _finished(told.groupBy("session_id").agg(*line_sums(told.columns))).drop("inner_id", "path")


def sessionize(lines: DataFrame, project: Callable[[str], Column] | None = None, typed_most: int | None = None) -> DataFrame:
    """One row a session: counts, and arrays of what is kept for local analysis. project: the project's name from the column ``path`` of lines; typed_most: as told_blocks takes it.

    Counts of results and states of tests are sums of their own, so who asks for these alone collects no text of a result.
    """
    line = line_table(lines)
    row = enriched_rows(block_table(line if project is not None else line.drop("path"), lines_too=True), typed_most)
    c = F.col
    s = row.groupBy("session_id").agg(
        *line_sums(row.columns),
        _ordered(F.struct(c("name"), F.coalesce("call_id", F.lit("")).alias("id"), c("file_path")), c("is_call")).alias("tool_calls"),
        _ordered(F.struct(F.coalesce("call_id", F.lit("")).alias("id"), c("is_error"), c("result").alias("text"), c("result_name").alias("name")), c("is_result")).alias("tool_results"),
        _ordered(F.struct(c("event_kind").alias("kind"), F.coalesce("name", "result_name").alias("name"), c("is_error"), has_code("shown").alias("has_code")), c("event_kind").isNotNull()).alias("events"),
        _ordered("subagent", c("subagent").isNotNull()).alias("subagent_types"), _ordered("typed", c("typed").isNotNull()).alias("user_texts"),
        _ordered("typed", c("is_prompt")).alias("prompt_texts"), _ordered("ts", c("is_prompt")).alias("prompt_times"),
        _ordered(F.left("shown", F.lit(V.TEXT_CAP)), c("shown").isNotNull()).alias("assistant_texts"), _ordered("ts", c("shown").isNotNull()).alias("assistant_times"),
        F.coalesce(F.sum("thinking"), F.lit(0)).alias("thinking_chars"), F.count("thinking").alias("thinking_blocks"),
        F.count_if("denied").alias("denials"), F.count_if(matches("typed", V.INTERRUPT)).alias("interruptions"), F.coalesce(F.bool_or(matches("typed", V.CONTINUATION)), F.lit(False)).alias("is_continuation"),
        F.count_if("is_result").alias("n_results"), F.count_if("is_error").alias("errors"), _last("test", "ord").alias("last_test"), F.coalesce(F.bool_or(c("test") == "fail"), F.lit(False)).alias("ever_failed"),
        F.count_if("commit").alias("commits"), F.coalesce(F.bool_or("push"), F.lit(False)).alias("pushed"), F.count_if("is_edit").alias("edit_results"), F.count_if("user_modified").alias("user_modified_edits"),
        F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed"),
    )
    # texts are not empty: so many fill the head, each of which is cut no shorter than that
    s = _finished(s).withColumn("assistant_text", F.left(F.array_join(F.slice("assistant_texts", 1, V.TEXT_CAP // 2 + 1), "\n"), F.lit(V.TEXT_CAP)))
    return s.withColumns({
        "project_label": F.lit("") if project is None else F.coalesce(project("path"), F.lit("unknown")),
        "tools_used": F.array_distinct(F.filter(F.transform("tool_calls", lambda t: t["name"]), lambda n: n.isNotNull())),
        "first_user_text": first_user_text(F.col("prompt_texts"), F.col("user_texts")),
    }).drop("inner_id", "path")
