import json
from datetime import datetime

from pyspark.sql import functions as F

from tests.conftest import TRANSCRIPT, call, result
from tracewright.operators.gate import DICTIONARY
from tracewright.operators.metrics import session_metrics
from tracewright.operators.sessionize import sessionize
from tracewright.plans.pipeline import labelled_sessions, records
from tracewright.sources.transcripts import lines, list_sessions, parse, read_files, read_lines
from tracewright.streaming.live import brain_events

NOW = datetime(2026, 1, 5)


def test_sessionize(spark, transcripts):
    files = read_files(spark, transcripts)
    assert files.count() == 2
    s = sessionize(lines(files)).where("turn_count > 0").first().asDict(recursive=True)
    expected = {
        "session_id": "0a1b2c3d-0000-4000-8000-00000000000a", "started_at": "2026-01-02T10:00:00Z", "ended_at": "2026-01-02T10:08:00Z", "duration_s": 480, "cwd": "/w", "git_branch": "main", "permission_mode": "plan",
        "turn_count": 7, "token_total": 507, "input_tokens": 50, "cache_read_tokens": 150, "cache_creation_tokens": 50, "service_tier": "standard", "model": "claude-sonnet-4", "compactions": 1,
        "max_parallel_tools": 2, "thinking_chars": 300, "thinking_blocks": 1, "denials": 1, "interruptions": 1, "is_continuation": False, "commits": 1, "pushed": True, "edit_results": 2, "user_modified_edits": 1,
        "lines_added": 5, "lines_removed": 1, "subagent_types": ["reviewer"], "tools_used": ["Read", "Edit", "Write", "mcp__srv__do", "Bash", "Task", "Grep"],
        "first_user_text": "Please fix the error in app.py, it should pass the tests", "prompt_texts": ["Please fix the error in app.py, it should pass the tests", "thanks, perfect"], "assistant_text": "All done. ```py```", "assistant_texts": ["All done. ```py```"],
    }
    assert {k: s[k] for k in expected} == expected
    assert len(s["user_texts"]) == 4
    assert [r["name"] for r in s["tool_results"]] == ["Read", "Edit", "Write", "mcp__srv__do", "Bash"]
    assert [e["kind"] for e in s["events"]][-3:] == ["tool_use", "tool_use", "text"]
    assert s["events"][-1]["has_code"]


def test_metrics(spark, transcripts):
    m = session_metrics(sessionize(lines(read_files(spark, transcripts)))).where("turn_count > 0").first()
    assert (m.error_rate, m.rework_score, m.denial_rate, m.user_edit_rate, m.cache_hit_ratio) == (0.2, 0.0, 0.2, 0.5, 0.75)
    assert m.tests_passed and not m.tests_failed and m.ever_failed
    assert m.satisfaction == "positive"
    assert m.frustration_score == 0.15
    # 0.5 + 0.2 + 0.1 + 0.1 - 0.06 - 0 - 0.05 - 0.075 - 0.05 - 0.015
    assert m.outcome_score == 0.65 and m.outcome == "partial"
    assert list(m.techniques) == ["subagents", "mcp_tools", "extended_thinking", "parallel_tools"]
    assert list(m.friction_reasons) == []


def test_records(spark, transcripts):
    out = records(spark, transcripts, NOW, salt="s")
    assert out.columns == [f.name for f in DICTIONARY] + ["coerced"]
    r = out.first()
    assert out.count() == 1
    assert r.activity_category == "debugging" and r.domain == "backend" and r.intent_summary == "debugging · backend"
    assert list(r.tools_used) == ["Read", "Edit", "Write", "Bash", "Task", "Grep"] and r.mcp_tool_count == 1 and len(r.mcp_tool_hashes[0]) == 12
    assert r.region_counts.visual == 2 and r.region_counts.parietal == 1 and r.region_counts.motor == 2
    assert r.started_at == datetime(2026, 1, 2, 10, 0) and r.schema_version == 4 and list(r.coerced) == []
    assert r.survival_rate == 0.0 and not r.git_analyzed
    assert records(spark, transcripts, NOW, usage=False).count() == 0


def test_digest_and_model_hook(spark, transcripts):
    s = labelled_sessions(lines(read_files(spark, transcripts)), lambda d: '```json\n{"activity_category": "testing", "domain": "nonsense"}\n```')
    r = s.first()
    assert (r.activity_category, r.domain, r.classifier) == ("testing", "other", "haiku_headless")
    assert r.digest.split("\n")[1] == "Tool calls (histogram): Bash:1, Edit:1, Grep:1, mcp:1, Read:1, Task:1, Write:1"
    assert r.digest.split("\n")[2] == "Edits: 2 edit/write result(s), +5/-1 lines, 1 commit(s)"


def test_session_files(spark, transcripts):
    assert {r.session_id[-1] for r in list_sessions(spark, transcripts).collect()} == {"a", "b"}


def test_brain_events(spark, transcripts):
    rows = read_files(spark, transcripts).select(F.explode(F.split("raw", "\n")).alias("line"))
    e = brain_events(rows, F.lit("shop")).collect()
    assert len(e) == 9
    by_task = {x.task: x for x in e}
    assert by_task["Reading /w/app.py"].region == "visual" and by_task["Reading /w/app.py"].tokens == 100
    assert by_task["MCP · srv/do"].region == "parietal" and by_task["Extended thinking"].tokens == 75 and by_task["Generating code"].tokens == 5
    assert by_task["Subagent: reviewer"].tokens == 5


def test_one_file_in_many_tasks(spark, transcripts, tmp_path):
    """The same session whether its file is one row or cut into pieces of bytes, between lines and within them."""
    big = tmp_path / "big" / "-Users-kim-code-shop"
    big.mkdir(parents=True)
    body = [json.dumps(x | {"message": x["message"] | {"id": f"{x['message']['id']}-{k}"}} if "id" in x.get("message", {}) else x) for k in range(60) for x in TRANSCRIPT]
    (big / "0a1b2c3d-0000-4000-8000-00000000000c.jsonl").write_text("\n".join([*body, "", "{torn", '{"type": "system", "subtype": "é' + "x" * 40_000 + '"}']))
    whole = sessionize(lines(read_files(spark, str(big)))).first()
    settings = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1024"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = read_lines(spark, str(big))
        assert rows.rdd.getNumPartitions() > 20
        assert sessionize(parse(rows)).first() == whole
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(whole.tool_calls) > 300


def test_lines_are_read_and_parsed_once(spark, transcripts):
    """Files are scanned once for lines and blocks, and no test on what is parsed parses it anew."""
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    parsed = parse(read_lines(spark, transcripts))
    assert optimized(parsed).lower().count("parsejson") + optimized(parsed).count("parse_json") == 1
    assert optimized(sessionize(parsed)).count("Relation [") == 1
    odd = spark.createDataFrame([(x,) for x in ("{}", " {\"a\": 1} ", "[]", "0", "0.0", "false", "true", "null", '""', '"0"', '"x"', "7", "", "  ", "{torn")], "line string")
    assert parse(odd).count() == 7


def test_results_are_read_whole(spark):
    """Tests and denials far down in long results count, and no text of a result is collected for them."""
    far = "line of output\n" * 400
    body = [call(1, "Bash", "c1"), result(1, "c1", far + "3 failed"), call(2, "Bash", "c2"), result(2, "c2", far + "12 passed"), call(3, "Bash", "c3"), result(3, "c3", far + "The user doesn't want to proceed")]
    s = sessionize(parse(spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(body)], "session_id string, line_no int, line string")))
    m = session_metrics(s).select("tests_passed", "tests_failed", "ever_failed", "denials")
    assert m.first() == (True, False, True, 1)
    assert [len(r["text"]) for r in s.first()["tool_results"]] == [len(far) + n for n in (8, 9, 32)]
    assert "AS tool_results" not in m._jdf.queryExecution().optimizedPlan().toString()
