"""Registered queries over odd tables, made here, against their SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.test_catalogue import rows
from tracewright.operators.intervals import summed, within
from tracewright.plans import catalogue

DAY = 86_400_000_000
FROM = 1_704_067_200_000_000


def write(folder, name, **columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def events(folder, found):
    """events of (microseconds since 2024 or none, user, type)."""
    us, user, kind = zip(*found)
    write(
        folder, "events", event_id=pa.array(range(len(found)), pa.int64()), ts=pa.array([None if x is None else FROM + x for x in us], pa.timestamp("us")), user_id=pa.array(user, pa.int64()), event_type=pa.array(kind),
        value=pa.array([1.0] * len(found)), props=pa.array(['{"k": %d}' % (i % 100) for i in range(len(found))]),
    )


def compared(spark, folder, name):
    """The query's rows, which its SQL gives too."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalogue.queries()[name](spark, str(folder)).toPandas()
    want = c.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
    return got


def test_session_bounds_round_to_milliseconds(spark, tmp_path):
    """Half a second from a fraction of a millisecond, times before 1970, and events without a time."""
    pairs = [(0, 499_500), (0, 499_499), (15_000_000, 69_499_557), (500_000, 1_999_913), (500, 500_999), (-2_000_000_000_000_000, -1_999_999_999_000_500), (None, 7_000_000), (None, None), (3, 3)]
    events(tmp_path, [(t, user, "view") for user, pair in enumerate(pairs) for t in pair])
    got = compared(spark, tmp_path, "session_bounds")
    assert dict(zip(got.session_id, got.duration_s))["0"] == 1


def test_commit_window_at_its_ends(spark, tmp_path):
    """Ends that meet, one time for many events, nulls, and crowds."""
    hour = DAY // 24
    found = [(0, 1, "a"), (hour, 2, "a"), (hour + 1, 3, "a"), (2 * hour, 1, "a"), (DAY - 1, 1, "a"), (DAY, 1, "a"), (5, None, "a"), (6, 1, None), (None, 1, "a"), (7, 1, "b")]
    events(tmp_path, found + [(3 * hour, k % 7, "a") for k in range(50)] + [(k * 7919 * 1_000_003 % (3 * DAY), k % 5, "a") for k in range(400)])
    compared(spark, tmp_path, "commit_window")


def test_points_of_spans_by_brute_force(spark):
    """Counts and ends of spans from none to years long are those of the pairs."""
    points = spark.range(300).select((F.col("id") % 2).alias("k"), F.timestamp_micros(F.pmod(F.xxhash64("id"), F.pow(F.lit(2.0), 12 + F.col("id") % 40).cast("long")) - 5_000).alias("t"), F.col("id").alias("v"))
    spans = spark.range(200).select("id", (F.col("id") % 2).alias("k"), F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(1)), F.pow(F.lit(2.0), 12 + F.col("id") % 40).cast("long")) - 5_000).alias("a"))
    spans = spans.withColumn("b", F.timestamp_micros(F.unix_micros("a") + F.when(F.col("id") % 9 == 0, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.pow(F.lit(2.0), F.col("id") % 50).cast("long"))))).unionByName(points.where("v < 20").select((1_000 + F.col("v")).alias("id"), "k", F.col("t").alias("a"), F.col("t").alias("b")))
    pairs = within(points, spans, "k", "t", "a", "b").groupBy("s.id").agg(F.count("*"), F.min("p.v"), F.max("p.v"))
    for unit in (1, 1_000, 3_600_000_000):
        got = summed(points, spans, "k", "t", "a", "b", "id", "v", unit_us=unit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_sessions_of_long_texts(spark, tmp_path):
    """Scores come from the whole of what a user typed; records cut it, as their SQL does, and blocks do not."""
    long, loud = "page " * 1000, "FIX THE PAGE " * 400
    head, tails = " ".join(f"word{i}" for i in range(20)) * 60, [" ".join(f"{x}{i}" for i in range(400)) for x in ("red", "blue")]
    said = {
        9: (f"{long}wtf", f"{long}wtf"), 11: (f"{loud}please", f"{loud}now"), 13: ("add a page", f"{long}[Request interrupted by user]"), 16: (long + "done", f"{long}thanks, perfect"),
        24: tuple(f"{head} {t}" for t in tails),
    }
    found = [(c, t, "user", x) for c, texts in said.items() for t, x in enumerate(texts)] + [(c, 2, "assistant", f"{long}all of it") for c in said]
    conv, turn, role, text = zip(*found)
    write(tmp_path, "conversations", conv_id=pa.array(conv, pa.int64()), turn=pa.array(turn, pa.int32()), role=pa.array(role), text=pa.array(text))
    events(tmp_path, [(DAY + 1_000_000 * i, c, kind) for c in said for i, kind in enumerate(("click", "error", "purchase"))])
    got = compared(spark, tmp_path, "session_scores").set_index("session_id")
    assert got.frustration_score.to_dict() == {"00000009-5e55": 0.4, "00000011-5e55": 0.15, "00000013-5e55": 0.075, "00000016-5e55": 0.075, "00000024-5e55": 0.0}
    assert got.satisfaction["00000016-5e55"] == "positive"
    compared(spark, tmp_path, "session_records")
    compared(spark, tmp_path, "session_blocks")
