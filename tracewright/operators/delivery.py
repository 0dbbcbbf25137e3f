"""Delivery of records: a sink with bounded batches, the import of history, and a report of the state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracewright.operators import ledger
from tracewright.sources.config import Config
from tracewright.sources.notes import BUCKETS, Notes, bucket_of, opened, put
from tracewright.sources.scratch import shared_folder

Post = Callable[[str, dict[str, str], str], int]  #: url, headers, body -> status


def http_post(url: str, headers: dict[str, str], body: str) -> int:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers, method="POST"), timeout=20) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


@dataclass
class Sent(WriterCommitMessage):
    attempted: int
    stored: int


class Sender(DataSourceWriter):
    """Posts the records of a task one by one. What a server took is noted at once under the hash of the record, so the next attempt leaves it out; a record whose
    note was lost with its task, between the answer and the note, goes out again with the same idempotency key. What became of each record is a file a task."""

    def __init__(self, url: str, headers: dict[str, str], folder: str, run: str, post: Post) -> None:
        self.url, self.headers, self.folder, self.run, self.post = url, headers, folder, run, post

    def _stored(self, row: Row, notes: Notes) -> bool:
        if row.key in notes.held:
            return True
        try:
            stored = 200 <= self.post(self.url, self.headers | {"idempotency-key": row.key}, row.body) < 300
        except OSError:
            return False
        if stored:
            notes.add(row.key, row.claude_session_id or "")
        return stored

    def write(self, iterator: Iterator[Row]) -> Sent:
        notes: dict[int, Notes] = {}
        files, run = opened(self.run)
        files.create_dir(run, recursive=True)
        path, sent = f"{run}/{TaskContext.get().partitionId():07d}.json", Sent(0, 0)
        with files.open_output_stream(f"{run}/.{TaskContext.get().taskAttemptId()}") as out:
            for row in iterator:
                held = notes.get(row.bucket) or notes.setdefault(row.bucket, Notes(self.folder, row.bucket))
                stored = self._stored(row, held)
                out.write((json.dumps({"claude_session_id": row.claude_session_id, "stored": stored}) + "\n").encode())
                sent.attempted, sent.stored = sent.attempted + 1, sent.stored + stored
        files.move(f"{run}/.{TaskContext.get().taskAttemptId()}", path)
        for held in notes.values():
            held.seal()
        return sent

    def commit(self, messages: list[Sent | None]) -> None:
        files, run = opened(self.run)
        files.create_dir(run, recursive=True)
        told = [m for m in messages if m is not None]
        put(files, f"{run}/_done", [json.dumps({"attempted": sum(m.attempted for m in told), "stored": sum(m.stored for m in told)})])

    def abort(self, messages: list[Sent | None]) -> None:
        """What was taken stays taken: the notes are kept for the next run."""


def _sink(sender: Sender) -> type[DataSource]:
    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tracewright_delivery"

        def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
            return sender

    return Sink


def deliver(records: DataFrame, config: Config, post: Post = http_post, folder: str | None = None) -> DataFrame:
    """Sends records, now and once, and gives claude_session_id and stored of each; nothing is sent where the tier ships no usage.

    folder: where it is noted what was sent, reached by all tasks. With the same folder a run that failed goes on where it stopped, and equal records are
    not sent again in later runs; without one the notes serve this call's own retries. Speculative attempts send at the same time and should be off.
    """
    spark = records.sparkSession
    if not config.usage:
        return records.where("false").selectExpr("claude_session_id", "true as stored")
    folder = folder or f"{shared_folder(spark)}/sent-{uuid.uuid4().hex}"
    run = f"{folder}/run-{uuid.uuid4().hex}"
    headers = {"content-type": "application/json", "authorization": f"Bearer {config.token}"}
    spark.dataSource.register(_sink(Sender(config.url.rstrip("/") + "/api/records", headers, f"{folder}/notes", run, post)))
    bodies = records.drop("coerced").selectExpr("claude_session_id", "to_json(struct(*)) as body").withColumn("key", F.sha2("body", 256)).withColumn("bucket", bucket_of("key"))
    bodies.repartition(BUCKETS, "bucket").write.format("tracewright_delivery").mode("append").save()
    return spark.read.schema("claude_session_id string, stored boolean").json(run)


def import_history(records: Callable[[], DataFrame], config: Config | None, marker: Path, *, skip: bool = False, post: Post = http_post, folder: str | None = None) -> str:
    """Sends all history once. The marker is written when something was stored or there was nothing, or the user declines; not where the tier ships nothing or all failed."""
    if config is None:
        return "config missing"
    now = datetime.now(timezone.utc).isoformat()
    if skip:
        marker.write_text(json.dumps({"at": now, "skipped": True}))
        return "skipped by user"
    if not config.usage:
        return f'skipped by tier "{config.tier}"'
    sent = deliver(records(), config, post, folder).selectExpr("count(*) as attempted", "count_if(stored) as stored").first()
    if sent.attempted and not sent.stored:
        return f"failed: 0 of {sent.attempted} sessions stored"
    marker.write_text(json.dumps({"at": now, "imported": sent.stored}))
    return f"done: {sent.stored} sessions imported"


def import_notice(config: Config, marker: Path) -> bool:
    """Whether the user is to be told, this once, that history can be imported."""
    told = marker.with_name("import-notice")
    if not config.usage or marker.exists() or told.exists():
        return False
    told.write_text(json.dumps({"at": datetime.now(timezone.utc).isoformat()}))
    return True


def survey(due: DataFrame, build: Callable[[str], DataFrame | None], config: Config, done: Callable[[str], None], post: Post = http_post) -> tuple[int, int]:
    """Rebuilds and sends each due session (a bounded queue), and tells ``done`` after each that was stored or had nothing to send. Returns surveyed and skipped."""
    surveyed = skipped = 0
    for row in due.collect():  # as many as the queue's limit
        try:
            built = build(row.session_id)
            sent = [] if built is None else deliver(built, config, post).collect()
        except Exception:  # noqa: BLE001  tried again at the next run
            skipped += 1
            continue
        if sent and not all(r.stored for r in sent):
            skipped += 1
            continue
        surveyed, skipped = surveyed + bool(sent), skipped + (not sent)
        done(row.session_id)
    return surveyed, skipped


def status(config: Config | None, marker: Path, entries: DataFrame, probe: str) -> list[str]:
    """The lines of a status report; the token is never among them."""
    if config is None:
        return ["config: missing"]
    mark = json.loads(marker.read_text()) if marker.exists() else {}
    state = f"skipped by user ({mark['at']})" if mark.get("skipped") else f"done ({mark['at']})" if mark.get("at") else "pending"
    mode = "off" if config.classify == "off" else "on (api-key override)" if config.api_key else "on (headless)"
    last = ledger.latest(entries, ledger.COST).first()
    shown = f"{last.activity_category or 'unknown'} · {last.domain or 'unknown'} · ${last.cost_usd or 0:.6f} ({last.classifier or 'unknown'})" if last else "none yet"
    out = [f"config: {config.url} · token set", f"history import: {state}", f"classification: {mode}", f"sharing tier: {config.tier}", *([f"note: {config.warning}"] if config.warning else []), f"last classification: {shown}"]
    if error := ledger.newer_error(entries).first():
        out.append(f"classification error: {error.message} ({error.error_ts})")
    return [*out, f"server: {probe}"]
