"""Joins of commits with time windows and with later messages, against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewright.operators.git_truth import reverted
from tracewright.operators.intervals import within


def test_within_equals_brute_force(spark):
    rnd = random.Random(5)
    t = lambda s: datetime(1969, 12, 20) + timedelta(seconds=s, microseconds=s % 7)
    days = 86_400 * 30
    points = [(i, rnd.choice("aab"), t(rnd.randrange(days))) for i in range(300)] + [(900, None, t(1)), (901, "a", None)]
    spans = [(i, rnd.choice("aab"), t(x := rnd.randrange(days)), t(x + int(10 ** rnd.uniform(0, 7)))) for i in range(120)]
    spans += [(800, "a", t(0), t(86_400 * 9_000)), (801, "a", t(9), t(8)), (802, "a", None, t(5)), (803, "c", t(0), t(5)), *((900 + i, p[1], p[2], p[2]) for i, p in enumerate(points[:5])), (800, "a", t(0), t(86_400 * 9_000))]
    p = spark.createDataFrame(points, "id int, repo string, at timestamp").withColumn("key", F.lit(1))
    s = spark.createDataFrame(spans, "id int, repo string, a timestamp, b timestamp").withColumn("level", F.lit("x"))
    got = within(p, s, "repo", "at", "a", "b")
    want = sorted((x[0], y[0]) for x in points for y in spans if x[1] and x[1] == y[1] and x[2] and y[2] and y[2] <= x[2] <= y[3])
    assert sorted((r.p.id, r.s.id) for r in got.collect()) == want and len(want) > 1000
    assert within(p.limit(0), s, "repo", "at", "a", "b").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "level" in plan[plan.index("Join Inner") :].split("\n")[0]


def test_reverted_equals_contains(spark):
    rnd = random.Random(7)
    subjects = ['Add cart', 'a "quoted" one', '"', '""', 'x"', '!!!', 'revert "Add cart"', "", None, "Ünï", "revert "]
    shas = ["abcdef0123", "ABCDEF9", "abc", "", None, "zzzzzzz1", "0000000"]
    commits = [(rnd.choice("st"), rnd.choice(shas), rnd.choice(subjects)) for _ in range(60)] + [("none", "abcdef0", "Add cart")]
    parts = ['revert "', '"', 'Revert "Add cart"', 'REVERT "Revert "Add cart""', 'a "quoted" one', "!!!", "xabcdef0123f", " abcdef9", "00000000", "zzzzzzz", "abc", "ünï", ' revert ""', ' revert """', "revert", " "]
    for n in (1, 3, 6):
        log = [(rnd.choice("st"), "".join(rnd.choices(parts, k=n))) for _ in range(6)] + [("t", None), ("t", "")]
        got = reverted(spark.createDataFrame(commits, "session_id string, sha string, subject string").withColumn("key", F.lit(1)), spark.createDataFrame(log, "session_id string, text string"))
        hit = lambda sha, sub, text: (bool(sub) and f'revert "{sub.lower()}"' in text.lower()) or (sha is not None and sha[:7].lower() in text.lower())
        want = {(s, sha) for s, sha, sub in commits for k, text in log if k == s and text is not None and hit(sha, sub, text)}
        rows = [(r.session_id, r.sha) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
