import json
import os
import subprocess
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import functions as F

from tracewright.operators import delivery, git_truth, ledger, records, tiers
from tracewright.operators.gate import DICTIONARY, documentation, enforce, validate
from tracewright.operators.prompts import with_advice
from tracewright.sources import config, git
from tracewright.sources.transcripts import is_own_classifier_path, read_ledger
from tracewright.streaming.live import throttled, upsert_batches

NOW = datetime(2026, 1, 5)


def test_settings(tmp_path):
    names, variables = (".new", ".old"), ("NEW_DIR", "OLD_DIR")
    assert config.settings_dir({"OLD_DIR": "/x"}, tmp_path, names, variables) == Path("/x")
    assert config.settings_dir({"NEW_DIR": ""}, tmp_path, names, variables) == tmp_path / ".new"
    (tmp_path / ".old").mkdir()
    assert config.settings_dir({}, tmp_path, names, variables) == tmp_path / ".old"
    assert config.pick({"A_T": "", "B_T": "full"}, "T", ("A_", "B_")) == ""
    assert config.without_prefix({"A_X": "1", "B": "2"}, "A_") == {"B": "2"}
    file = tmp_path / "plugin.json"
    assert config.load(file) is None
    file.write_text(json.dumps({"url": "http://h/", "token": "t", "tier": "Metrics", "classify": "off"}))
    c = config.load(file)
    assert (c.tier, c.usage, c.facts, c.classify) == ("metrics", True, False, "off")
    assert config.load(file, env_tier="fulll").tier == "off"
    salt = config.load_salt(tmp_path / "s")
    assert len(salt) == 64 and config.load_salt(tmp_path / "s") == salt
    (tmp_path / "s" / "salt").write_text(" \n")
    assert len(config.load_salt(tmp_path / "s")) == 64


def test_git_relations(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=k", "-c", "user.email=k@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("-c", "core.editor=true", "commit", "-qm", "root", "--allow-empty", "--date", "2020-01-01T00:00:00Z")  # blame marks the lines of a root commit
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=k", "-c", "user.email=k@x", "commit", "-q", "--amend", "--allow-empty", "-m", "root"], check=True, capture_output=True, env=os.environ | {"GIT_COMMITTER_DATE": "2020-01-01T00:00:00Z"})
    (tmp_path / "a.py").write_text("1\n2\n3\n4\n")
    run("add", "-A")
    run("commit", "-qm", "Add a")
    now = datetime.now(timezone.utc)
    got = git.read("s", now - timedelta(hours=1), now + timedelta(hours=1), git.git_in(str(tmp_path)))
    frame = lambda k, schema: spark.createDataFrame(got[k], schema)
    sessions = spark.createDataFrame([("s", int(now.timestamp() * 1000))], "session_id string, ended_ms long")
    out = git_truth.analyze(
        sessions, frame("commits", "session_id string, sha string, subject string, ord int"), frame("numstat", "sha string, added string, removed string, path string, ord int"),
        frame("blame", "session_id string, path string, sha string, line int"), frame("commit_meta", "sha string, email string, time_ms long"), frame("later_log", "session_id string, text string"),
    ).first()
    assert (out.commits_in_window, out.lines_added, out.lines_surviving, out.survival_rate, out.reverts) == (1, 4, 4, 1.0, 0)
    assert git.read("s", now, now, git.git_in("/nonexistent")) is None


def test_commit_window(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    commits = spark.createDataFrame([("r", f"c{h}", "x", t(h)) for h in range(1, 8)], "repo string, sha string, subject string, committed_at timestamp")
    sessions = spark.createDataFrame([("s", "r", t(2), t(4)), ("z", "q", t(1), t(7))], "session_id string, repo string, started_at timestamp, ended_at timestamp")
    assert {r.sha for r in git_truth.in_window(commits, sessions).collect()} == {"c2", "c3", "c4", "c5"}


def test_gate_dictionary(spark):
    raw = spark.createDataFrame([("0a1b2c3d", "2026-01-01T00:00:00Z"), ("", "2026-01-01T00:00:00Z"), ("0a1b2c3d", None)], "claude_session_id string, started_at string")
    out = enforce(raw, NOW)
    assert out.columns[:-1] == [f.name for f in DICTIONARY] and len(DICTIONARY) == 58
    good, bad = validate(raw, NOW)
    assert (good.count(), bad.count()) == (1, 2)
    r = good.first()
    assert (r.outcome, r.classifier, r.schema_version, r.region_counts.motor, r.survival_rate, list(r.tools_used)) == ("unknown", "deterministic", 3, 0, None, [])
    assert documentation().count("\n") == 60


def test_git_time_quirk(spark):
    raw = spark.createDataFrame([("2026-01-01T00:00:30.5Z",), ("2026-01-01T00:01:00Z",)], "git_analyzed_at string")
    assert [r.git_analyzed_at for r in enforce(raw, NOW, compat=True).collect()] == ["", "2026-01-01T00:01:00.000Z"]
    assert enforce(raw, NOW).first().git_analyzed_at == datetime(2026, 1, 1, 0, 0, 30, 500000)


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    nudges = spark.createDataFrame([("t1", "s", "rework", None, None), ("t2", "", "rework", "", "")], "ts string, session_id string, kind string, level string, category string")
    ledger.append(ledger.entries_of_nudges(nudges).coalesce(1), path)
    ledger.append(ledger.cost_entries(spark.createDataFrame([("t3", "s", "-1", "c")], "ts string, session_id string, cost_usd string, classifier string").withColumns({"activity_category": F.lit(None).cast("string"), "domain": F.lit("x")})).coalesce(1), path)
    ledger.append(ledger.error_entries(spark.createDataFrame([("t4", "m" * 400)], "ts string, message string")).coalesce(1), path)
    got = read_ledger(spark, path)
    assert {(r.kind, r.cost_usd, len(r.message or "")) for r in got.collect()} == {("rework", None, 0), ("classify_cost", 0.0, 0), ("classify_error", None, 300)}


def test_delivery_and_import(spark, tmp_path):
    recs = spark.createDataFrame([("a",), ("b",)], "claude_session_id string").withColumn("coerced", F.array())
    c = config.Config("http://h/", "t")
    marker = tmp_path / "marker"
    assert delivery.import_notice(c, marker) and not delivery.import_notice(c, marker)
    assert delivery.import_history(lambda: recs, c, marker, post=lambda *_: 500).startswith("failed") and not marker.exists()
    assert delivery.import_history(lambda: recs, config.Config("http://h", "t", tier="presence"), marker).startswith("skipped by tier") and not marker.exists()
    assert delivery.import_history(lambda: recs, c, marker, post=lambda url, headers, body: 200 if json.loads(body)["claude_session_id"] == "a" else 500) == "done: 1 sessions imported"
    empty = spark.createDataFrame([], "line_no long, ts string, kind string, cost_usd double, classifier string, activity_category string, domain string, message string")
    lines = delivery.status(c, marker, empty, "connected")
    assert lines[1].startswith("history import: done") and lines[-1] == "server: connected" and not any(" t " in x for x in lines)
    done = []
    due = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")

    def build(session):
        if session == "c":
            raise OSError
        return recs.limit(1) if session == "a" else None

    assert delivery.survey(due, build, c, done.append, post=lambda *_: 200) == (1, 2)
    assert done == ["a", "b"]


def test_tier_flags_and_advice(spark):
    d = spark.createDataFrame([(["a"], False), (["a"], True)], "facts array<string>, ship boolean")
    assert [r.facts for r in tiers.strip_facts(d, "facts", "ship").collect()] == [[], ["a"]]
    names = spark.createDataFrame([("off",), ("nonsense",)], "t string").select(tiers.describe("t").alias("m"))
    assert [r.m for r in names.collect()] == ["nothing leaves this machine", "usage records and session facts both ship (default)"]
    assert with_advice(spark.createDataFrame([("vague_goal",), ("x",)], "antipattern string")).where("advice is null").count() == 1


def test_own_classifier_path(spark):
    d = spark.createDataFrame([("-Users-x--tool-classify/a.jsonl",), ("/home/x/.tool/classify/a",), ("/home/x/mytool/classify",)], "p string")
    assert [r.b for r in d.select(is_own_classifier_path("p", "tool").alias("b")).collect()] == [True, True, False]


def test_throttle_stream(spark, tmp_path):
    t = lambda m: datetime(2026, 1, 1, 10, m)
    schema = "session_id string, kind string, ts timestamp"
    spark.createDataFrame([("a", "k", t(0)), ("a", "k", t(5)), ("a", "k", t(12)), ("b", "k", t(1))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, stream = [], throttled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.session_id, r.ts.minute) for r in out) == [("a", 0), ("a", 12), ("b", 1)]
    batch = ledger.throttle(spark.read.parquet(str(tmp_path / "in")), ["session_id", "kind"], "ts")
    assert sorted((r.session_id, r.ts.minute) for r in batch.collect()) == [("a", 0), ("a", 12), ("b", 1)]


def test_upsert_stream(spark, tmp_path):
    held = {}
    merge = upsert_batches(lambda: held.get("df"), lambda df: held.update(df=spark.createDataFrame(df.collect(), df.schema)), "k", "seq")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    merge(rows(("a", 1, 1), ("b", 1, 1)), 0)
    merge(rows(("a", 2, 2), ("b", 0, 0)), 1)
    assert {(r.k, r.v) for r in held["df"].collect()} == {("a", 2), ("b", 1)}


def test_mean_survival(spark):
    d = spark.createDataFrame([("t", True, 0.5), ("t", True, None), ("t", False, 0.0)], "team string, git_analyzed boolean, survival_rate double")
    assert git_truth.mean_survival(d, "team").first().survival_rate == 0.5
    assert spark.range(1).select(records.verdict_bucket(F.lit("win - late"))).first()[0] == "win"
