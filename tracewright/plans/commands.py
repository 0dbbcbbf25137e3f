"""What the command line does with a sender's settings: import history, measure again, report."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import delivery
from tracewright.operators.records import survey_queue
from tracewright.operators.sessionize import sessionize
from tracewright.plans.pipeline import Ask, git_truth_of, records
from tracewright.sources import hooks
from tracewright.sources.config import Config, load, load_salt
from tracewright.sources.transcripts import list_sessions, parse, read_ledger_tail, read_lines


def _records(spark: SparkSession, root: str, now: datetime, config: Config, settings: Path, **more: object):
    ledger = settings / "ledger.jsonl"
    return records(spark, root, now, salt=load_salt(settings), labels=config.labels, ledger=str(ledger) if ledger.exists() else None, usage=config.usage, ship_facts=config.facts, **more)


def backfill(spark: SparkSession, root: str, now: datetime, settings: Path, *, skip: bool = False, post: delivery.Post = delivery.http_post) -> str:
    """Imports all history once; what is sent is labelled by rules alone."""
    config = load(settings / "config.json")
    return "history import: " + delivery.import_history(lambda: _records(spark, root, now, config, settings), config, settings / "imported", skip=skip, post=post)


def resurvey(spark: SparkSession, root: str, now: datetime, settings: Path, *, most: int = 1000, post: delivery.Post = delivery.http_post) -> str:
    """Sends records of sessions that ended 7 to 30 days ago once more, with what became of their commits: one plan for the queue, which reads the files of its sessions alone. What was stored is noted in a ledger."""
    config, done = load(settings / "config.json"), settings / "surveyed.jsonl"
    if config is None:
        return "config: missing"
    if not config.usage:
        return "re-surveyed 0 sessions"
    held = [(json.loads(x)["session_id"],) for x in done.read_text().splitlines() if x.strip()] if done.exists() else []
    due = survey_queue(list_sessions(spark, root), spark.createDataFrame(held, "session_id string"), now, most=most)
    due = due.select("session_id", "path").collect()  # as many as the queue's limit
    if not due:
        return "re-surveyed 0 sessions"
    files = [r.path for r in due]
    own = sessionize(parse(read_lines(spark, files)))
    built = _records(spark, root, now, config, settings, git=git_truth_of(spark, own, now), files=files)
    stored = {r.claude_session_id: r.stored for r in delivery.deliver(built, config, post).collect()}
    with done.open("a") as f:  # what failed is tried again at the next run; what had nothing to send is not
        f.writelines(json.dumps({"session_id": s}) + "\n" for s in sorted({r.session_id for r in due}) if stored.get(s, True))
    return f"re-surveyed {sum(stored.values())} sessions"


def finish(spark: SparkSession, told: str, now: datetime, settings: Path, *, post: delivery.Post = delivery.http_post) -> str:
    """What a host's hook calls when a session ends: sends the record of the transcript that the host names on the hook's input."""
    config, path = load(settings / "config.json"), hooks.transcript_path(told)
    if config is None:
        return "config: missing"
    if not path:
        return "no transcript"
    return _sent(_records(spark, str(Path(path).parent.parent), now, config, settings, files=[path]), config, post)


def enrich(spark: SparkSession, told: hooks.Enrichment, now: datetime, *, answer: Ask | None = None, api: Ask | None = None, post: delivery.Post = delivery.http_post) -> str:
    """What the process that a hook leaves behind does: labels one session, by a model where one is given, and sends its record again."""
    if not told.file or not told.url or not told.token:
        return "nothing to enrich"
    settings = Path(told.settings) if told.settings else None
    config = (load(settings / "config.json") if settings else None) or Config(told.url, told.token)
    config = replace(config, url=told.url, token=told.token)
    ledger = settings / "ledger.jsonl" if settings else None
    built = records(
        spark, told.transcripts or str(Path(told.file).parent.parent), now, salt=load_salt(settings) if settings else None, labels=told.labels, ledger=str(ledger) if ledger and ledger.exists() else None,
        usage=config.usage, ship_facts=config.facts and told.ship_facts, answer=answer, api=api, files=[told.file],
    )
    return _sent(built, config, post)


def _sent(built: DataFrame, config: Config, post: delivery.Post) -> str:
    n = delivery.deliver(built, config, post).selectExpr("count(*) as tried", "count_if(stored) as stored").first()
    return f"stored {n.stored} of {n.tried} records"


def report(spark: SparkSession, settings: Path, *, post: delivery.Post = delivery.http_post) -> list[str]:
    """The state of settings, import, classification and server."""
    config = load(settings / "config.json")
    probe = ""
    if config is not None:
        try:
            code = post(config.url.rstrip("/") + "/api/records", {"content-type": "application/json", "authorization": f"Bearer {config.token}"}, "{}")
            probe = "token rejected" if code in (401, 403) else "connected"
        except OSError as e:
            probe = f"unreachable ({e})"
    return delivery.status(config, settings / "imported", read_ledger_tail(spark, str(settings / "ledger.jsonl")).withColumn("session_id", F.coalesce("session_id", F.lit(""))), probe)
