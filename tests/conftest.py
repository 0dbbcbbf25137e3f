import json

import pytest
from pyspark.sql import SparkSession

from tracewright.sources.transcripts import configure


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return configure(s)


def call(line_id, name, call_id, **inputs):
    return {"type": "assistant", "timestamp": f"2026-01-02T10:{line_id:02d}:00Z", "message": {"id": f"m{line_id}", "model": "claude-sonnet-4", "usage": {"output_tokens": 100, "input_tokens": 10, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 10, "service_tier": "standard"}, "content": [{"type": "tool_use", "name": name, "id": call_id, "input": inputs}]}}


def result(line_id, call_id, text="ok", error=False, **extra):
    return {"type": "user", "timestamp": f"2026-01-02T10:{line_id:02d}:30Z", "message": {"content": [{"type": "tool_result", "tool_use_id": call_id, "content": text, "is_error": error}]}, **extra}


TRANSCRIPT = [
    {"type": "user", "sessionId": "inner", "timestamp": "2026-01-02T10:00:00Z", "cwd": "/w", "gitBranch": "main", "permissionMode": "plan", "message": {"content": "Please fix the error in app.py, it should pass the tests"}},
    {"type": "user", "message": {"content": [{"type": "text", "text": "<system-reminder>injected</system-reminder>"}]}},
    call(1, "Read", "c1", file_path="/w/app.py"),
    result(1, "c1", "content"),
    call(2, "Edit", "c2", file_path="/w/app.py"),
    result(2, "c2", "done", toolUseResult={"userModified": True, "structuredPatch": [{"lines": ["+a", "+b", "-c", " d"]}]}),
    call(3, "Write", "c3", file_path="/w/new.py"),
    result(3, "c3", "done", toolUseResult={"file": {"content": "x\ny\nz"}}),
    call(4, "mcp__srv__do", "c4"),
    result(4, "c4", "The user doesn't want to proceed with this", True),
    call(5, "Bash", "c5", command="pytest"),
    result(5, "c5", "12 passed", toolUseResult={"gitOperation": {"commit": "abc", "push": True}}),
    {"type": "assistant", "timestamp": "2026-01-02T10:06:00Z", "message": {"id": "m6", "usage": {"output_tokens": 7}, "content": [{"type": "thinking", "thinking": "hm" * 150}, {"type": "tool_use", "name": "Task", "id": "c6", "input": {"subagent_type": "reviewer"}}, None]}},
    {"type": "assistant", "timestamp": "2026-01-02T10:06:10Z", "message": {"id": "m6", "usage": {"output_tokens": 7}, "content": [{"type": "tool_use", "name": "Grep", "id": "c7", "input": {"pattern": "x"}}]}},
    {"type": "system", "subtype": "auto_compact"},
    {"type": "assistant", "timestamp": "2026-01-02T10:07:00Z", "message": {"content": [{"type": "text", "text": "  All done. ```py```  "}]}},
    {"type": "user", "timestamp": "2026-01-02T10:08:00Z", "message": {"content": [{"type": "text", "text": "thanks, perfect"}, {"type": "text", "text": "[Request interrupted by user]"}]}},
]


@pytest.fixture()
def transcripts(tmp_path):
    root = tmp_path / "-Users-kim-code-shop"
    (root / "subagents").mkdir(parents=True)
    body = "\n".join(["", *map(json.dumps, TRANSCRIPT), "{not json", "null", '{"type":"user","type":"system","subtype":"x"}'])
    (root / "0a1b2c3d-0000-4000-8000-00000000000a.jsonl").write_text(body)
    (root / "0a1b2c3d-0000-4000-8000-00000000000b.jsonl").write_text(json.dumps({"type": "summary"}))
    (root / "subagents" / "sub.jsonl").write_text(body)
    return str(tmp_path)
