"""The five relations of repositories' histories, read by git commands in the tasks of a Spark job."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame

from tracewright.functions import vocab as V
from tracewright.sources.scratch import cut

Run = Callable[[list[str]], str | None]
Relations = dict[str, list[tuple]]
SCHEMAS = {
    "commits": "session_id string, sha string, subject string, ord int", "numstat": "sha string, added string, removed string, path string, ord int", "blame": "session_id string, path string, sha string, line int",
    "commit_meta": "sha string, email string, time_ms long", "later_log": "session_id string, text string",
}


def git_in(folder: str) -> Run:
    """A runner of git in a folder; null where git fails."""

    def run(args: list[str]) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, errors="replace")
        return done.stdout if done.returncode == 0 else None

    return run


def read(session_id: str, started: datetime, ended: datetime, run: Run) -> Relations | None:
    """commits, numstat, blame, commit_meta and later_log rows of one session; none without a repository or a log."""
    iso = lambda t: t.astimezone(timezone.utc).isoformat()
    until = ended + timedelta(hours=V.GIT_SLACK_HOURS)
    if run(["rev-parse", "--is-inside-work-tree"]) is None:
        return None
    log = run(["log", f"--since={iso(started)}", f"--until={iso(until)}", "--no-merges", "--format=%H%x09%s"])
    if log is None:
        return None
    out: Relations = {k: [] for k in ("commits", "numstat", "blame", "commit_meta", "later_log")}
    for i, line in enumerate([x for x in log.splitlines() if x][: V.COMMITS_CAP], 1):
        sha, _, subject = line.partition("\t")
        out["commits"].append((session_id, sha, subject, i))
        for n, row in enumerate((run(["show", "--numstat", "--format=", sha]) or "").splitlines()):
            if len(cells := row.split("\t", 2)) == 3:
                out["numstat"].append((sha, *cells, n))
    paths = list(dict.fromkeys(r[3] for r in out["numstat"] if r[1] != "-"))[: V.FILES_CAP]
    for path in paths:
        for n, row in enumerate((run(["blame", "-w", "-M", "-C", "-l", "-s", "HEAD", "--", path]) or "").splitlines()):
            out["blame"].append((session_id, path, row[:40], n))
    for sha in sorted({r[1] for r in out["commits"]} | {r[2] for r in out["blame"] if re.fullmatch("[0-9a-f]{40}", r[2])}):
        said = (run(["show", "-s", "--format=%ae%x09%ct", sha]) or "").strip().rpartition("\t")
        if said[2].isdigit():
            out["commit_meta"].append((sha, said[0], int(said[2]) * 1000))
    # a message names a commit within a line: each is a row
    out["later_log"] += [(session_id, line) for line in (run(["log", f"--since={iso(until)}", "--format=%s%x09%b"]) or "").splitlines() if line]
    return out


#: Rows of all relations in one table, and where each relation's columns lie in it.
ROW = "relation string, session_id string, sha string, text string, path string, added string, removed string, n long"
PLACES = {
    "asked": ("session_id",), "commits": ("session_id", "sha", "text", "n"), "numstat": ("sha", "added", "removed", "path", "n"), "blame": ("session_id", "path", "sha", "n"),
    "commit_meta": ("sha", "text", "n"), "later_log": ("session_id", "text"),
}
BATCH = 10_000


def relations(due: DataFrame, run_in: Callable[[str], Run] = git_in) -> dict[str, DataFrame]:
    """The relations of sessions (session_id, cwd, a, b: start and end in ms), and ``asked``: the sessions that have a repository.

    Sessions are dealt to tasks one by one, so a repository that most ran in is many tasks; executors must reach the folders.
    What was read is written to the shared folder once. A commit that several sessions saw is one commit in numstat and commit_meta.
    """
    names = [c.split(" ")[0] for c in ROW.split(", ")]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        for f in frames:
            for session_id, cwd, a, b in f[["session_id", "cwd", "a", "b"]].itertuples(index=False):
                found = read(session_id, at(a), at(b), run_in(cwd))
                for relation, rows in ({} if found is None else {"asked": [(session_id,)]} | found).items():
                    for i in range(0, len(rows), BATCH):
                        part = pd.DataFrame(rows[i : i + BATCH], columns=list(PLACES[relation]), dtype=object).reindex(columns=names)
                        yield part.assign(relation=relation).astype(object).where(lambda d: d.notna(), None)

    tasks = int(due.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(due.repartition(tasks, "session_id").mapInPandas(ask, ROW))
    out = {}
    for relation, places in PLACES.items():
        of = rows.where(rows.relation == relation).select(*places)
        schema = SCHEMAS.get(relation, "session_id string")
        out[relation] = of.toDF(*(c.split(" ")[0] for c in schema.split(", "))).selectExpr(*(f"CAST({n} AS {t}) AS {n}" for n, t in (c.split(" ") for c in schema.split(", "))))
    out["numstat"] = out["numstat"].dropDuplicates(["sha", "path", "ord"])
    out["commit_meta"] = out["commit_meta"].dropDuplicates(["sha"])
    return out
