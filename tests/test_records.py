"""From files to records: projects, labels, nudges, git truth, a model's answers, and the edges that feed them."""

import json
import os
import random
import time
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import TRANSCRIPT
from tracewright.functions.text import counted
from tracewright.operators import labels, ledger
from tracewright.plans import commands
from tracewright.plans.pipeline import git_truth_of, labelled_sessions, records
from tracewright.sources import hooks
from tracewright.sources.transcripts import lines, read_files, read_ledger_tail
from tracewright.streaming.live import brain_events

NOW = datetime(2026, 1, 5)
ONE, TWO = "0a1b2c3d-0000-4000-8000-000000000001", "0a1b2c3d-0000-4000-8000-000000000002"
SHA = "a" * 40


def two_projects(tmp_path):
    for folder, session in (("-Users-kim-code-shop", ONE), ("-home-kim-api gate", TWO)):
        (tmp_path / "t" / folder).mkdir(parents=True)
        (tmp_path / "t" / folder / f"{session}.jsonl").write_text("\n".join(map(json.dumps, TRANSCRIPT)))
    return str(tmp_path / "t")


def test_projects_labels_nudges_and_git(spark, tmp_path):
    root = two_projects(tmp_path)
    book = tmp_path / "ledger.jsonl"
    book.write_text(json.dumps({"ts": "2026-01-02T10:00:00Z", "session_id": ONE, "kind": "rework"}) + "\n{torn")
    plain = {r.claude_session_id: r.project_label for r in records(spark, root, NOW).collect()}
    assert plain == {ONE: "shop", TWO: "api-gate"}
    git = spark.createDataFrame([(ONE, 0.5, 5, 0, 1)], "session_id string, survival_rate double, lines_surviving long, lines_superseded long, reverts long")
    got = {r.claude_session_id: r for r in records(spark, root, NOW, salt="s", labels={"shop": "My Shop"}, ledger=str(book), git=git).collect()}
    assert got[ONE].project_label == "my-shop" and got[TWO].project_label.startswith("p-")
    assert list(got[ONE].nudges_shown) == ["rework"] and list(got[TWO].nudges_shown) == []
    assert got[ONE].git_analyzed and got[ONE].survival_rate == 0.5 and not got[TWO].git_analyzed and got[TWO].survival_rate == 0.0
    assert [r.claude_session_id for r in records(spark, root, NOW, only=TWO).collect()] == [TWO]
    hashed = {r.project_label for r in records(spark, root, NOW, salt="s").collect()}
    assert len(hashed) == 2


def test_facts_reach_the_record(spark, tmp_path):
    said = json.dumps({"result": json.dumps({"activity_category": "testing", "domain": "backend", "facts": [{"k": "goal", "v": "tidy"}, {"k": "risk", "v": 2}]}), "total_cost_usd": 0.5})
    calls = tmp_path / "calls"

    def answer(_: str) -> str:
        with calls.open("a") as f:
            f.write("x")
        return said

    out = records(spark, two_projects(tmp_path), NOW, answer=answer).collect()
    assert {(r.classifier, r.activity_category) for r in out} == {("haiku_headless", "testing")}
    assert [[(e.k, e.v_num, e.v_str) for e in r.session_facts] for r in out] == [[("goal", None, "tidy"), ("risk", 2.0, None)]] * 2
    assert calls.read_text() == "xx"  # each session is asked about once
    bare = records(spark, two_projects(tmp_path / "again"), NOW, answer=lambda _: said, ship_facts=False)
    assert all(list(r.session_facts) == [] for r in bare.collect())


def test_api_rung(spark, transcripts):
    def api(body: str) -> str:
        asked = json.loads(body)
        assert asked["tool_choice"]["name"] == asked["tools"][0]["name"] and "Turn count: 7" in asked["messages"][0]["content"]
        return json.dumps({"content": [{"type": "tool_use", "input": {"activity_category": "testing", "domain": "mobile", "facts": [{"k": "risk", "v": 1.5}]}}]})

    def fails(_: str) -> str:
        raise OSError

    source = lines(read_files(spark, transcripts))
    r = labelled_sessions(source, answer=lambda _: "never asked", api=api).first()
    assert (r.classifier, r.activity_category, r.domain, r.facts[0].v_num) == ("haiku_api", "testing", "mobile", 1.5)
    assert labelled_sessions(source, api=fails).first().classifier == "deterministic"
    assert spark.range(1).select(labels.model_prompt(F.lit("Turns: 3"))).first()[0].count("Turns: 3") == 1


def test_git_truth_of_sessions(spark):
    def run_in(folder: str):
        def run(args: list[str]) -> str | None:
            if folder != "/repo":
                return None
            if args[0] == "log":
                return f"{SHA}\tAdd cart\n" if any("--until" in a for a in args) else 'Revert "Add cart"'
            if args[0] == "blame":
                return "\n".join([SHA + " 1) x"] * 3)
            if args[0] == "show":
                return "4\t0\ta.py\n" if "--numstat" in args else "k@x\t1767348000"
            return "true"

        return run

    s = spark.createDataFrame([("s1", "/repo", 1, "2026-01-02T10:00:00Z", "2026-01-02T11:00:00Z"), ("s2", "/gone", 1, "2026-01-02T10:00:00Z", "2026-01-02T11:00:00Z"), ("s3", "/repo", 0, "2026-01-02T10:00:00Z", "2026-01-02T11:00:00Z")], "session_id string, cwd string, commits int, started_at string, ended_at string")
    out = git_truth_of(spark, s, NOW, run_in).collect()
    assert [(r.session_id, r.lines_surviving, r.reverts, r.survival_rate) for r in out] == [("s1", 3, 1, 0.75)]


def test_git_truth_of_one_repository(spark):
    """Sessions that saw the same commit count its lines once each; no session at all is no row; nothing runs on the driver."""
    driver = os.getpid()

    def run_in(folder: str):
        assert os.getpid() != driver

        def run(args: list[str]) -> str | None:
            if args[0] == "log":
                return f"{SHA}\tAdd cart\n" if any("--until" in a for a in args) else f'fix\tbody\n\nRevert "add"\tThis reverts {SHA[:9]}\n'
            if args[0] == "blame":
                return "\n".join([SHA + " 1) x"] * 3)
            if args[0] == "show":
                return "4\t0\ta.py\n-\t-\tx.png\n" if "--numstat" in args else "k@x\t1767348000"
            return "true"

        return run

    span = ("/repo", 1, "2026-01-02T10:00:00Z", "2026-01-02T11:00:00Z")
    schema = "session_id string, cwd string, commits int, started_at string, ended_at string"
    out = git_truth_of(spark, spark.createDataFrame([(f"s{i}", *span) for i in range(5)], schema), NOW, run_in).collect()
    assert sorted((r.session_id, r.commits_in_window, r.lines_added, r.lines_surviving, r.reverts) for r in out) == [(f"s{i}", 1, 4, 3, 1) for i in range(5)]
    assert git_truth_of(spark, spark.createDataFrame([], schema), NOW, run_in).count() == 0


def test_hook_channel():
    assert hooks.transcript_path('{"transcript_path": "/t/a.jsonl"}') == "/t/a.jsonl"
    assert [hooks.transcript_path(x) for x in (None, "", "[1]", "{", '{"transcript_path": 3}')] == [""] * 5
    told = hooks.Enrichment("/t/a.jsonl", "/t", "http://h", "tok", "/s", "", {"shop": "x"}, False)
    back = hooks.of_environment(hooks.to_environment(told, "NEW_"), ("NEW_", "OLD_"), "HOST_KEY")
    assert back == told
    assert hooks.of_environment({"OLD_FILE": "f", "NEW_PROJECT_LABELS": "{", "HOST_KEY": "k"}, ("NEW_", "OLD_"), "HOST_KEY") == hooks.Enrichment(file="f", api_key="k")


def test_ledger_tail(spark, tmp_path):
    file = tmp_path / "ledger.jsonl"
    assert read_ledger_tail(spark, str(file)).count() == 0
    rows = [json.dumps({"ts": f"{i:04d}", "session_id": "s", "kind": "rework"}) for i in range(100)]
    file.write_text("\n".join(rows) + "\n")
    size = len(rows[0]) + 1
    assert [r.ts for r in read_ledger_tail(spark, str(file), most=3 * size + 5).orderBy("line_no").collect()] == ["0097", "0098", "0099"]
    assert read_ledger_tail(spark, str(file)).count() == 100


@pytest.mark.parametrize(("hot", "run"), [(1_000_000, 10_000), (0, 10_000), (0, 3), (40, 0)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_throttle_matches_a_loop(spark, monkeypatch, hot, run, kind):
    """Keys in one task, and hot ones split over tasks, whose runs are folded or followed by doubled pointers."""
    monkeypatch.setattr(ledger, "HOT", hot)
    monkeypatch.setattr(ledger, "RUN", run)
    rng = random.Random(5)
    data = [(k, s, rng.choice([1, 1, 1, 50]) * rng.randrange(40_000)) for k in ("a", None) for s in (1, 2) for _ in range(80)]
    data += [("hot", 1, 97 * i) for i in range(400)] + [("same", 1, 5)] * 3 + [("edge", 1, 600 * i) for i in range(5)] + [("none", 1, None)]
    rows = spark.createDataFrame([(k, s, None if t is None else t) for k, s, t in data], "k string, s int, sec long").selectExpr("k", "s", f"cast(timestamp_seconds(sec) as {kind}) as ts")
    want = []
    for key in {d[:2] for d in data}:
        last = None
        for t in sorted({d[2] for d in data if d[:2] == key and d[2] is not None}):
            if last is None or t >= last + 600:
                want.append((*key, t))
                last = t
    got = ledger.throttle(rows, ["k", "s"], "ts")
    assert got.schema["ts"].dataType.typeName() == kind
    assert Counter((r.k, r.s, r.t) for r in got.selectExpr("k", "s", "unix_seconds(cast(ts as timestamp)) as t").collect()) == Counter(want)


def test_counted(spark):
    d = spark.createDataFrame([(["b", "a", None, "b"],), ([],), ([None],)], "x array<string>")
    assert [[(e.value, e.n) for e in r[0]] for r in d.select(counted(F.col("x"))).collect()] == [[("a", 1), ("b", 2)], [], []]


def test_brain_events_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, TRANSCRIPT)))
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    run = brain_events(stream, F.lit("shop"), F.lit("now")).writeStream.format("memory").queryName("brain").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = brain_events(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "line"), F.lit("shop"), F.lit("now"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(spark.table("brain").collect()) == order(batch.collect()) and spark.table("brain").count() == 9


def test_commands(spark, tmp_path):
    root, settings, sent = two_projects(tmp_path), tmp_path / "settings", tmp_path / "sent"
    settings.mkdir()
    now = datetime.now(timezone.utc)

    def post(url: str, headers: dict, body: str) -> int:
        with sent.open("a") as f:
            f.write(body + "\n")
        return 200

    assert commands.report(spark, settings, post=post) == ["config: missing"] and commands.resurvey(spark, root, now, settings, post=post) == "config: missing"
    (settings / "config.json").write_text(json.dumps({"url": "http://h", "token": "t"}))
    assert commands.backfill(spark, root, now, settings, post=post) == "history import: done: 2 sessions imported"
    assert {json.loads(x)["claude_session_id"] for x in sent.read_text().splitlines()} == {ONE, TWO}
    assert any(x.startswith("history import: done") for x in commands.report(spark, settings, post=post))
    old = time.time() - 10 * 86_400
    os.utime(next((tmp_path / "t").glob(f"*/{ONE}.jsonl")), (old, old))
    assert commands.resurvey(spark, root, now, settings, post=post) == "re-surveyed 1 sessions"
    assert json.loads((settings / "surveyed.jsonl").read_text())["session_id"] == ONE
    assert commands.resurvey(spark, root, now, settings, post=post) == "re-surveyed 0 sessions"
    sent.write_text("")
    file = str(next((tmp_path / "t").glob(f"*/{TWO}.jsonl")))
    assert commands.finish(spark, json.dumps({"transcript_path": file}), now, settings, post=post) == "stored 1 of 1 records"
    assert commands.finish(spark, "{", now, settings, post=post) == "no transcript"
    told = hooks.Enrichment(file=file, url="http://h", token="t", settings=str(settings), labels={})
    assert commands.enrich(spark, told, now, post=post) == "stored 1 of 1 records" and commands.enrich(spark, hooks.Enrichment(), now, post=post) == "nothing to enrich"
    first, again = (json.loads(x) for x in sent.read_text().splitlines())
    assert first["claude_session_id"] == again["claude_session_id"] == TWO and first["project_label"] == again["project_label"]
