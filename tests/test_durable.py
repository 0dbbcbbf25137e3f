"""What is done once: records sent, answers asked, versions stored."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.operators import delivery, labels
from tracewright.operators.store import Conflict, KeyedStore
from tracewright.sources.config import Config
from tracewright.sources.notes import Notes

CONFIG = Config("http://h/", "t")


def posted(path):
    return Counter(path.read_text().split()) if path.exists() else Counter()


def test_a_failed_run_sends_nothing_twice(spark, tmp_path):
    recs = spark.range(60).selectExpr("concat('s', id) as claude_session_id", "id % 3 as v", "array() as coerced")
    log, broken = tmp_path / "log", tmp_path / "broken"
    broken.write_text("")

    def post(url, headers, body):
        key = json.loads(body)["claude_session_id"]
        assert headers["idempotency-key"] and "coerced" not in body
        if key == "s7" and broken.exists():
            raise ValueError("the task dies")
        if key == "s8":
            raise OSError("no answer")
        with log.open("a") as f:
            f.write(key + "\n")
        return 500 if key == "s9" else 200

    folder = str(tmp_path / "sent")
    with pytest.raises(Exception, match="the task dies"):
        delivery.deliver(recs, CONFIG, post, folder)
    before = posted(log)
    broken.unlink()
    got = {r.claude_session_id: r.stored for r in delivery.deliver(recs.repartition(7), CONFIG, post, folder).collect()}
    assert len(got) == 60 and sorted(k for k in got if not got[k]) == ["s8", "s9"]
    after = posted(log)
    assert 0 < sum(before.values()) < 60 and all(n == 1 for k, n in after.items() if k != "s9") and len(after) == 59
    again = delivery.deliver(recs, CONFIG, post, folder)
    assert again.where("stored").count() == 58 and again.count() == 60  # what is read twice is not sent twice
    assert {k: n for k, n in posted(log).items() if k != "s9"} == {k: n for k, n in after.items() if k != "s9"}
    changed = delivery.deliver(recs.withColumn("v", F.expr("if(claude_session_id = 's1', 9, v)")), CONFIG, post, folder)
    assert changed.count() == 60 and posted(log)["s1"] == 2 and posted(log)["s2"] == 1  # a record that has changed is another one


def test_delivery_of_awkward_records(spark, tmp_path):
    none = spark.createDataFrame([], "claude_session_id string, coerced array<string>")
    assert delivery.deliver(none, CONFIG, lambda *_: 200).collect() == []
    rows = spark.createDataFrame([(None, "x"), ("a", "y" * 300_000), ("a", "y" * 300_000), ("é\n\"", None)], "claude_session_id string, key string").withColumn("coerced", F.array())
    got = delivery.deliver(rows, CONFIG, lambda *_: 200, str(tmp_path / "s"))
    assert Counter(r.claude_session_id for r in got.collect()) == {None: 1, "a": 2, "é\n\"": 1} and got.where("stored").count() == 4


def test_answers_are_asked_once(spark, tmp_path):
    log, broken, folder = tmp_path / "asked", tmp_path / "broken", str(tmp_path / "answers")
    broken.write_text("")
    rows = spark.range(40).selectExpr("lpad(id, 3, '0') as asker", "concat('q', id % 10) as request").withColumn("key", F.sha2("request", 256))

    def ask(request):
        if request == "q3" and broken.exists():
            raise ValueError("no answer")
        with log.open("a") as f:
            f.write(request + "\n")
        return "said " + request

    first = labels.answers_once(rows, ask, folder)
    got = {r.asker: r.answer for r in first.collect()}
    assert len(got) == 10 and got["000"] == "said q0" and got["003"] is None
    broken.unlink()
    again = {r.asker: r.answer for r in labels.answers_once(rows.where("asker >= '010'").unionByName(spark.createDataFrame([("x", "new", "k"), ("y", None, None)], rows.schema)), ask, folder).collect()}
    assert again["000"] == "said q0" and again["013"] == "said q3" and again["x"] == "said new" and len(again) == 11  # who asked first stays the one that paid
    assert first.count() == 10 and set(posted(log).values()) == {1} and len(posted(log)) == 11
    assert labels.answers_once(rows.where("false"), ask, folder).count() == 0


def test_notes_of_a_lost_attempt(tmp_path):
    lost = Notes(str(tmp_path / "n"), 3)
    lost.add("a", "1")
    lost.add("b", "é\n2")
    (tmp_path / "n" / "bucket-00003" / ".half").write_text('["c"')
    next_one = Notes(f"file:{tmp_path}/n", 3)
    assert next_one.held == {"a": "1", "b": "é\n2"}
    next_one.add("c", "3")
    next_one.seal()
    assert Notes(str(tmp_path / "n"), 3).held == {"a": "1", "b": "é\n2", "c": "3"} and Notes(str(tmp_path / "n"), 4).held == {}


def test_store_equals_a_dictionary(spark, tmp_path):
    rnd, store, want = random.Random(5), KeyedStore(spark, str(tmp_path / "store"), "k", "seq", buckets=8), {}
    assert store.read() is None
    for _ in range(4):
        batch = [(rnd.choice([None, "hot", "hot", *map(str, range(30))]), rnd.randrange(6), rnd.random()) for _ in range(60)]
        batch = list({(k, s): (k, s, v) for k, s, v in batch}.values())
        store.merge(spark.createDataFrame(batch, "k string, seq long, v double"))
        for k, s, v in batch:
            if k not in want or s >= want[k][0]:
                want[k] = (s, v)
        assert {r.k: (r.seq, r.v) for r in store.read().collect()} == want and store.read().count() == len(want)


def test_store_rewrites_touched_buckets_alone(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    store = KeyedStore(spark, str(tmp_path / "store"), "k", "seq", buckets=16)
    store.merge(rows(*((str(i), i, 1) for i in range(100))))
    old, before = store.read(), store.manifest()["folders"]
    assert len(before) > 10
    store.merge(rows(("5", -1, 2)))
    after = store.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert old.where("k = '5'").first().v == 5 and store.read().where("k = '5'").first().v == -1  # a reader keeps its version
    version = store.manifest()["version"]
    store.merge(rows())
    assert store.manifest()["folders"] == after and store.manifest()["version"] == version + 1
    with pytest.raises(ValueError, match="columns"):
        store.merge(spark.createDataFrame([("a", 1)], "k string, seq int"))
    store.clean(keep=1)
    assert store.read().count() == 100


def test_of_two_writers_the_second_merges_anew(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    store, other = (KeyedStore(spark, str(tmp_path / "store"), "k", "seq", buckets=2) for _ in range(2))
    store.merge(rows(("a", 1, 1), ("b", 1, 1)))
    publish, once = store._publish, []

    def late(manifest):
        if not once:
            once.append(other.merge(rows(("a", 7, 7), ("c", 1, 1))))
        publish(manifest)

    monkeypatch.setattr(store, "_publish", late)
    store.merge(rows(("b", 2, 2), ("a", 2, 2)))
    assert {(r.k, r.v) for r in store.read().collect()} == {("a", 7), ("b", 2), ("c", 1)} and store.manifest()["version"] == 3
    with pytest.raises(Conflict):
        store._publish({"version": 3})


def test_a_stream_into_the_store(spark, tmp_path):
    schema = "k string, v int, seq int"
    store = KeyedStore(spark, str(tmp_path / "store"), "k", "seq", buckets=4)
    for n, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("b", 0, 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.for_each_batch("s")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert store.manifest()["batches"] == {"s": n}
    version = store.manifest()["version"]
    store.for_each_batch("s")(spark.createDataFrame([("a", 99, 99)], schema), 1)  # given once more after a failure
    assert store.manifest()["version"] == version and {(r.k, r.v) for r in store.read().collect()} == {("a", 2), ("b", 1)}
