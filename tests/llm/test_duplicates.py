import pytest

from tests.llm.helpers import awkward, components, frame, removed, rows
from tracewright.llm import jaccard, suffix
from tracewright.llm.components import components as connect


@pytest.mark.parametrize("boundary", [None, 2, 40])
def test_links_match_brute_force(spark, boundary):
    data = rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, data), boundary=boundary, frequent_from=3).collect()}
    assert got == components(data)


def test_many_near_copies_and_a_common_passage(spark):
    base = [f"w{i}" for i in range(80)]
    copies = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :]), None, None, None) for i in range(40)]
    shared = [(100 + i, " ".join([f"p{j}" for j in range(40)] + [f"own{i}x{j}" for j in range(30)]), None, None, None) for i in range(40)]
    short = [(200 + i, " ".join(f"s{j}" for j in range(5 + i)), None, None, None) for i in range(12)]
    data = copies + shared + short
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, data), frequent_from=4).collect()}
    assert got == components(data)


def test_links_of_a_driver_table_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()}
    assert got == components(data)
    assert any(c != i for i, (_, c) in got.items())


def test_many_ranges_and_long_lists_in_parts(spark, monkeypatch):
    """Counts are split into more ranges, lists are met in parts, and the map of frequent shingles is too small for all."""
    for name, value in (("SUM_KEYS", 4), ("PART", 3), ("MAP_BITS", (6, 6))):
        monkeypatch.setattr(jaccard, name, value)
    data = rows(n=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, data), frequent_from=2).collect()}
    assert got == components(data)


def test_link_awkward_rows(spark):
    d = awkward(spark)
    got = jaccard.link(d).collect()
    assert len(got) == d.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.link(frame(spark, [])).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connect(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("broadcast", [32 << 20, 100])
def test_removed_bytes_match_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(suffix, "BUCKET", 300)
    monkeypatch.setattr(suffix, "SAMPLE", 600)
    data = rows()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(suffix.deduplicate(frame(spark, data))).collect()}
    assert got == removed(data)


def test_removal_awkward_rows(spark):
    d = awkward(spark)
    got = suffix.digest(suffix.deduplicate(d)).collect()
    assert len(got) == d.count() and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert suffix.digest(suffix.deduplicate(frame(spark, []))).count() == 0


def test_multikey_order(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    monkeypatch.setattr(suffix, "SMALL", 40)
    cols = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = suffix.multikey_order(cols)
    keys = list(zip(*(c[order] for c in cols)))
    assert keys == sorted(keys)
