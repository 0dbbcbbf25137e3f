"""Sessions kept up to date while their transcripts grow: what sessionize counts, folded batch by batch.

The JSON is read on the JVM. A session's state is a map of messages (the first line of each counts), a map of calls with
the noted results that wait for their name, and sums. Each part is replaced by what it has become and the sums get the
difference, so lines may come in any order and be cut into any batches. Texts are not kept, but for the head of what
the assistant said and the first prompt; arrays of calls, results and texts are sessionize's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.functions import vocab as V
from tracewright.functions.text import matches
from tracewright.operators.sessionize import block_table, duration_s, line_table, told_blocks

USAGE = {"output_tokens": "token_total", "input_tokens": "input_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_creation_tokens"}
FIRST, LAST = {"inner_id": "inner_id", "started_at": "ts"}, {"ended_at": "ts", "model": "model", "cwd": "cwd", "git_branch": "git_branch", "permission_mode": "permission_mode"}
FLAGS = {"denied": "denials", "interrupted": "interruptions", "commit": "commits", "thought": "thinking_blocks"}
EDITS = ("edit_results", "user_modified_edits", "lines_added", "lines_removed")
COUNTS = ("lines", "turn_count", *USAGE.values(), "max_parallel_tools", "compactions", *FLAGS.values(), "thinking_chars", *EDITS)
TEXTS = (*FIRST, *LAST, "service_tier", "assistant_text", "first_user_text")
OUTPUT = "session_id string, " + ", ".join(f"{n} long" for n in COUNTS) + ", pushed boolean, is_continuation boolean, tools_used array<string>, " + ", ".join(f"{n} string" for n in TEXTS)
MESSAGE = "line_no long, tier string, " + ", ".join(f"{n} long" for n in USAGE) + ", n_calls long"


def told(lines: DataFrame) -> DataFrame:
    """What parsed lines (session_id, line_no long, v) and their blocks tell, a row each; a line's own row has block -1."""
    line, c = line_table(lines), F.col
    own = line.select(
        "session_id", "line_no", F.lit(-1).alias("block_no"), "inner_id", "ts", "cwd", "git_branch", "permission_mode", F.when(c("is_assistant"), c("model")).alias("model"), F.when(c("is_assistant"), c("msg")).alias("msg"), "service_tier", *USAGE, c("n_calls").cast("long").alias("n_calls"),
        ((c("type") == "system") & F.lower("subtype").contains("compact")).alias("compacted"),
    )
    b = told_blocks(block_table(line))
    unset = lambda n: F.coalesce(c(n).cast("long"), F.lit(-1)).alias(n)
    blocks = b.select(
        "session_id", "line_no", "block_no", "call_id", "is_call", F.when(c("is_call"), c("name")).alias("name"), "noted", unset("added"), unset("removed"), unset("written"), "modified", "commit", "push",
        F.left("shown", F.lit(V.TEXT_CAP)).alias("shown"), "typed", "is_prompt", c("thinking").isNotNull().alias("thought"), c("thinking").cast("long").alias("thinking"),
        matches("result", V.DENIAL).alias("denied"), matches("typed", V.INTERRUPT).alias("interrupted"), matches("typed", V.CONTINUATION).alias("continued"),
    )
    return own.unionByName(blocks, allowMissingColumns=True).fillna(0).fillna(False)


def _edits(parts: dict) -> list[int]:
    """Edits, edits that the user changed, lines added and removed by the noted results of one call's id, each named by the latest call before it."""
    calls, sums = sorted(parts["calls"]), [0, 0, 0, 0]
    for at, added, written, removed, modified in parts["results"]:
        name = next((n for a, n in reversed(calls) if a < at), "")
        if name in V.EDIT_TOOLS:
            grown = added if added >= 0 else written if name == "Write" and written >= 0 else 0
            sums = [x + y for x, y in zip(sums, (1, int(modified), grown, max(removed, 0)))]
    return sums


def _head(texts: list) -> list:
    """The first texts by place, those that begin before the cut."""
    kept, used = [], 0
    for at, text in sorted(texts):
        if used >= V.TEXT_CAP:
            break
        kept.append([at, text])
        used += len(text) + 1
    return kept


class SessionFold(StatefulProcessor):
    """State of a session: its messages, its calls, its sums.

    A message or call that nothing has touched for keep_hours is forgotten (a later repeat of the message would count as
    a turn of its own); sums are forgotten after idle_hours. State is so bounded by what is open, not by what has been.
    """

    def __init__(self, keep_hours: float, idle_hours: float) -> None:
        self.keep_ms, self.idle_ms = int(keep_hours * 3_600_000), int(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "msg string", MESSAGE, self.keep_ms)
        self.calls = handle.getMapState("calls", "call_id string", "parts string", self.keep_ms)
        self.sums = handle.getValueState("sums", "sums string", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.sums.get()
        s = json.loads(held[0]) if held else {"n": dict.fromkeys(COUNTS, 0), "ends": {}, "tools": {}, "head": [], "pushed": False, "continued": False}
        messages, calls = {}, {}
        for frame in rows:
            for r in frame.to_dict("records"):
                if r["block_no"] < 0:
                    self._line(s, messages, r)
                else:
                    self._block(s, calls, r)
        self._settle_messages(s, messages)
        for call, parts in calls.items():
            found = self.calls.getValue((call,))
            before = json.loads(found[0]) if found else {"calls": [], "results": []}
            after = {k: before[k] + parts[k] for k in before}
            for n, x, y in zip(EDITS, _edits(before), _edits(after)):
                s["n"][n] += y - x
            self.calls.updateValue((call,), (json.dumps(after),))
        s["head"] = _head(s["head"])
        self.sums.update((json.dumps(s),))
        ends = {n: s["ends"].get(n, [None, ""])[1] for n in (*FIRST, *LAST, "service_tier")}
        blank = {n: v if v or n not in ("inner_id", "started_at", "ended_at") else None for n, v in ends.items()}
        said = s["ends"].get("prompt") or s["ends"].get("typed") or [None, ""]
        yield pd.DataFrame([{
            "session_id": key[0], **s["n"], "pushed": s["pushed"], "is_continuation": s["continued"], "tools_used": sorted(s["tools"], key=s["tools"].get),
            **blank, "assistant_text": "\n".join(t for _, t in s["head"])[: V.TEXT_CAP], "first_user_text": said[1],
        }])

    @staticmethod
    def _end(s: dict, name: str, at: list, value: object, last: bool) -> None:
        held = s["ends"].get(name)
        if value is not None and (held is None or (at > held[0]) == last):
            s["ends"][name] = [at, value]

    def _line(self, s: dict, messages: dict, r: dict) -> None:
        at = [r["line_no"], -1]
        for last, ends in ((False, FIRST), (True, LAST)):
            for name, column in ends.items():
                self._end(s, name, at, r[column], last)
        s["n"]["lines"] += 1
        s["n"]["compactions"] += int(r["compacted"])
        if r["msg"] is not None:
            messages.setdefault(r["msg"], []).append((r["line_no"], r["service_tier"], *(int(r[u]) for u in USAGE), int(r["n_calls"])))

    def _settle_messages(self, s: dict, messages: dict) -> None:
        lost = False
        for msg, came in messages.items():
            before = self.messages.getValue((msg,))
            before = tuple(before) if before else None
            every = [*came, *([before] if before else [])]
            first = min(every, key=lambda x: x[0])
            after = (*first[:-1], sum(x[-1] for x in every))
            s["n"]["turn_count"] += before is None
            s["n"]["max_parallel_tools"] = max(s["n"]["max_parallel_tools"], after[-1])
            for n, x, y in zip(USAGE.values(), before[2:6] if before else (0,) * 4, after[2:6]):
                s["n"][n] += y - x
            held = s["ends"].get("service_tier")
            lost |= before is not None and before[0] != after[0] and held is not None and held[0] == [before[0], -1]
            self._end(s, "service_tier", [after[0], -1], after[1], True)
            self.messages.updateValue((msg,), after)
        if lost:  # the line that told the tier is no longer its message's first
            s["ends"].pop("service_tier")
            for _, m in self.messages.iterator():
                self._end(s, "service_tier", [m[0], -1], m[1], True)

    def _block(self, s: dict, calls: dict, r: dict) -> None:
        at = [r["line_no"], r["block_no"]]
        for flag, name in FLAGS.items():
            s["n"][name] += int(r[flag])
        s["n"]["thinking_chars"] += int(r["thinking"])
        s["pushed"] |= bool(r["push"])
        s["continued"] |= bool(r["continued"])
        self._end(s, "typed", at, r["typed"], False)
        self._end(s, "prompt", at, r["typed"] if r["is_prompt"] else None, False)
        if r["shown"] is not None:
            s["head"].append([at, r["shown"]])
        if r["is_call"] and r["name"] is not None:
            s["tools"][r["name"]] = min(at, s["tools"].get(r["name"], at))
        if r["call_id"] is not None and ((r["is_call"] and r["name"] is not None) or r["noted"]):
            parts = calls.setdefault(r["call_id"], {"calls": [], "results": []})
            if r["is_call"]:
                parts["calls"].append([at, r["name"]])
            else:
                parts["results"].append([at, int(r["added"]), int(r["written"]), int(r["removed"]), bool(r["modified"])])

    def close(self) -> None:
        pass


def session_counts(lines: DataFrame, *, keep_hours: float = 24, idle_hours: float = 24 * 30) -> DataFrame:
    """A stream of parsed lines (session_id, line_no long, v) -> sessions as they stand, a row for each that a batch has touched.

    Output mode is update; of several rows of a session that with most ``lines`` is the last. Needs the RocksDB state store.
    State that expires asks for one more batch without end, so a run that is to stop (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    fold = told(lines).groupBy("session_id").transformWithStateInPandas(SessionFold(keep_hours, idle_hours), OUTPUT, "update", "processingTime")
    return fold.withColumns({
        "session_id": F.coalesce(F.nullif("session_id", F.lit("")), "inner_id", F.lit("")),
        "duration_s": duration_s(F.try_to_timestamp("started_at"), F.try_to_timestamp("ended_at")),
    }).drop("inner_id")
