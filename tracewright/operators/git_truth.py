"""What became of a session's commits: survival of lines and reverts, from five relations of repositories.

commits(session_id, sha, subject, ord), numstat(sha, added, removed, path, ord), blame(session_id, path, sha, line),
commit_meta(sha, email, time_ms), later_log(session_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.scalars import round3
from tracewright.operators.intervals import summed, within


def in_window(commits: DataFrame, sessions: DataFrame, slack_hours: int = V.GIT_SLACK_HOURS) -> DataFrame:
    """Commits (repo, sha, subject, committed_at) of each session's repository between its start and an hour after its end."""
    until = F.col("ended_at") + F.expr(f"interval {slack_hours} hours")
    pairs = within(commits, sessions, "repo", "committed_at", "started_at", until)
    return pairs.select("s.session_id", "p.sha", "p.subject", "p.committed_at")


def counts_in_window(commits: DataFrame, sessions: DataFrame, slack_hours: int = V.GIT_SLACK_HOURS) -> DataFrame:
    """session_id, commits, first_sha, last_sha of what in_window gives, summed up without its pairs. A session_id is one session's."""
    until = F.col("ended_at") + F.expr(f"interval {slack_hours} hours")
    found = summed(commits, sessions, "repo", "committed_at", "started_at", until, "session_id", "sha", unit_us=max(1, slack_hours) * 3_600_000_000)
    return found.select(F.col("span").alias("session_id"), F.col("n").alias("commits"), F.col("least").alias("first_sha"), F.col("greatest").alias("last_sha"))


def capped(commits: DataFrame, most: int = V.COMMITS_CAP) -> DataFrame:
    """The first commits of each session, in log order."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return commits.withColumn("n", n).where(F.col("n") <= most).drop("n")


def touched(commits: DataFrame, numstat: DataFrame, most: int = V.FILES_CAP) -> tuple[DataFrame, DataFrame]:
    """Lines added per session over all files, and its first files in order. Binary files have '-' for counts and are left out."""
    rows = commits.join(numstat.withColumnRenamed("ord", "file_ord"), "sha").where(F.col("added").rlike(r"^[0-9]+\z") & F.col("removed").rlike(r"^[0-9]+\z"))
    added = rows.groupBy("session_id").agg(F.sum(F.col("added").cast("long")).alias("lines_added"))
    seen = rows.groupBy("session_id", "path").agg(F.min(F.struct("ord", "file_ord")).alias("at"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    return added, seen.withColumn("n", n).where(F.col("n") <= most).select("session_id", "path")


def mention_keys(text: Column | str) -> Column:
    """Keys under which a message can name commits: what each ``revert "`` is followed by up to the next quote, and every seven hex digits in a row."""
    t = F.lower(text)
    named, hexes = F.regexp_extract_all(t, F.lit('(?<=revert ")[^"]*(?=")'), F.lit(0)), F.regexp_extract_all(t, F.lit("(?=([0-9a-f]{7}))"), F.lit(1))
    return F.array_distinct(F.concat(F.transform(named, lambda x: F.concat(F.lit("s"), x)), F.transform(hexes, lambda x: F.concat(F.lit("h"), x))))


def reverted(commits: DataFrame, later_log: DataFrame) -> DataFrame:
    """Commits (session_id, sha, subject) that a later message of their session (session_id, text; any number of rows) names: ``revert "subject"`` or the first seven digits of sha stand in it, in any case.

    Messages are indexed by mention_keys; session and key are the join's key, so a session with most rows is many tasks. The key of a
    subject is its part before a quote: without a quote in it the key proves the mention, others are looked for in the text, and so is
    what is no seven hex digits. An empty or null subject, or a null sha, names nothing.
    """
    subject, short = F.lower("subject"), F.lower(F.substring("sha", 1, 7))
    named = commits.where(F.length("subject") > 0).select("session_id", "sha", F.concat(F.lit("s"), F.substring_index(subject, '"', 1)).alias("key"), F.concat(F.lit('revert "'), subject, F.lit('"')).alias("needle"), F.contains(subject, F.lit('"')).alias("doubtful"))
    hexes = commits.where(short.rlike(r"^[0-9a-f]{7}\z")).select("session_id", "sha", F.concat(F.lit("h"), short).alias("key"), short.alias("needle"), F.lit(False).alias("doubtful"))
    index = later_log.select("session_id", F.explode(mention_keys("text")).alias("key"))
    hits = named.unionByName(hexes).join(index, ["session_id", "key"], "left_semi")
    other = commits.where(~short.rlike(r"^[0-9a-f]{7}\z")).select("session_id", "sha", short.alias("needle"))
    looked = hits.where("doubtful").select("session_id", "sha", "needle").unionByName(other)
    seen = looked.join(later_log.select("session_id", F.lower("text").alias("text")), "session_id").where(F.contains("text", "needle"))
    return hits.where("not doubtful").select("session_id", "sha").unionByName(seen.select("session_id", "sha")).distinct()


def survival_rate(surviving: Column, superseded: Column, added: Column) -> Column:
    lost = F.greatest(F.lit(0), added - surviving - superseded)
    return F.when(surviving + lost > 0, round3(surviving / (surviving + lost)))


def analyze(sessions: DataFrame, commits: DataFrame, numstat: DataFrame, blame: DataFrame, commit_meta: DataFrame, later_log: DataFrame, *, most_commits: int = V.COMMITS_CAP, most_files: int = V.FILES_CAP) -> DataFrame:
    """session_id, commits_in_window, lines_added, lines_surviving, lines_superseded, survival_rate, reverts of sessions (session_id, ended_ms)."""
    own = capped(commits, most_commits)
    added, files = touched(own, numstat, most_files)
    lines = blame.join(files, ["session_id", "path"], "left_semi").where(F.col("sha").rlike(r"^[0-9a-f]{40}\z"))
    mine = own.select("session_id", "sha").distinct().withColumn("mine", F.lit(True))
    lines = lines.join(mine, ["session_id", "sha"], "left")
    lead = own.groupBy("session_id").agg(F.min_by("sha", "ord").alias("sha")).join(commit_meta, "sha").select("session_id", F.col("email").alias("author"))
    others = lines.where("mine is null").join(commit_meta, "sha").join(lead, "session_id").join(sessions, "session_id")
    superseded = others.where("email = author and time_ms > ended_ms").groupBy("session_id").agg(F.count("*").alias("lines_superseded"))
    surviving = lines.where("mine").groupBy("session_id").agg(F.count("*").alias("lines_surviving"))
    counts = own.groupBy("session_id").agg(F.count("*").alias("commits_in_window"))
    reverts = reverted(own, later_log).groupBy("session_id").agg(F.countDistinct("sha").alias("reverts"))
    out = sessions.select("session_id")
    for part in (counts, added, surviving, superseded, reverts):
        out = out.join(part, "session_id", "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("commits_in_window", "lines_added", "lines_surviving", "lines_superseded", "reverts")}
    return out.withColumns(zero).withColumn("survival_rate", survival_rate(F.col("lines_surviving"), F.col("lines_superseded"), F.col("lines_added")))


def mean_survival(records: DataFrame, *by: str) -> DataFrame:
    """Extension: mean survival of analysed records; null rates do not count."""
    return records.where("git_analyzed").groupBy(*by).agg(F.avg("survival_rate").alias("survival_rate"), F.count("survival_rate").alias("scored"))
