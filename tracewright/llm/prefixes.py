"""Operator 11, conversation prefix trie: which first turns conversations share.

A node is a distinct sequence of first turns (role, text). Sequences are told apart by keys of 128 bits: the
exclusive-or of hashes of (place, role, text), so a turn's row has the key of its prefix from one running
window, and a node's parent has its key without its last turn.

1. Conversations with the same whole sequence are one (the smallest conv_id) with a count, so a group of copies,
   however large, is one path. Their ids are hashed in order as a stream.
2. Paths are dealt by a hash of their first turn, and each bucket builds its pointer tries (dictionaries from a
   turn to a child) inside applyInPandas; sums go up in postorder, without recursion, since nodes are made after their parents.
3. A first turn with more than MOST rows below it is parted by its next turn, and again, until each part fits:
   rows below every prefix are counted at once, so a long shared prefix costs no more rounds than a short one.
   The nodes above the parts ("upper") are summed as DataFrames: each value belongs to the smallest member of its node,
   suffix sums along that member's path give what lies below each of its upper nodes, and one aggregation by key adds them.

Defined results: rows without a conv_id are ignored; a null role or text is empty; turns are ordered by turn, nulls
first, rows of the same turn by role and then by a hash of the text; repeated rows are turns each; a conversation
without turns ends in the root; an empty table has no nodes; columns other than conv_id, turn, role and text are never
read. A conversation's rows are numbered by one window (sorted, spilled to disk if need be).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import mapped, rows_bound, settle

#: Rows of a subtrie that is built in one piece, rows of a bucket, and rows of a broadcast.
MOST, BUCKET, BROADCAST_ROWS = 30_000, 60_000, 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), two hashes of role and text, n_bytes of the text."""
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(n, F.lit("")).alias(n) for n in ("role", "text")))
    c = c.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(11), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    return c.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "a", "b", "n_bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the conversations rebuilt as the contract says, and conv_id with n_turns of each, those without turns among them.

    A base conversation serves nine others at most, with eight turns at most each.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", head.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = sizes.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.join(bases, "base", "left").select("conv_id", "h", "base", "n", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int").alias("lead"))
    convs = settle(convs.withColumn("n_turns", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int")), "trie-conversations")
    led = own.where("pos < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base").join(convs.where("lead > 0"), "base").where("pos < lead")
    rest = own.withColumn("from", head.cast("int")).where("pos >= from").join(convs.select("conv_id", "lead"), "conv_id").withColumn("pos", F.expr("pos - from + lead"))
    columns = ("conv_id", "pos", "a", "b", "n_bytes")
    return led.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "n_turns")


def prefix_trie(turn_rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turn_rows (conv_id, pos from 0 without gaps, a, b, n_bytes) over all members convs (conv_id, n_turns)."""
    spark = convs.sparkSession
    along = Window.partitionBy("conv_id").orderBy("pos")
    rows = turn_rows.join(convs, "conv_id").withColumns({f"h{i}": F.xxhash64(F.lit(i), "pos", "a", "b") for i in (1, 2)})
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"h{i}").over(along) for i in (1, 2)}).withColumns({f"f{i}": F.first(f"k{i}").over(along) for i in (1, 2)})
    rows = settle(rows.select("conv_id", "pos", "n_turns", "n_bytes", "h1", "h2", "k1", "k2", "f1", "f2"), "trie-turns")

    last = rows.where("pos = n_turns - 1").select("k1", "k2", "conv_id").unionByName(convs.where("n_turns = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    whole = settle(mapped(last.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id"), _ends, "k1 long, k2 long, conv_id long, n long, ends string"), "trie-ends")
    ends = F.when(F.expr("pos = n_turns - 1"), F.col("ends")).alias("ends")
    rows = settle(rows.join(whole.select("conv_id", "n", "ends"), "conv_id").select(*rows.columns, "n", ends), "trie-paths")

    big = settle(rows.groupBy("f1", "f2").count().where(F.col("count") > MOST).select("f1", "f2"), "trie-big")
    deep = _parted(rows.join(_small(big), ["f1", "f2"]))
    dealt = rows.join(_small(big), ["f1", "f2"], "left_anti").withColumns({"g1": F.col("f1"), "g2": F.col("f2")})
    dealt = dealt.select(*(c for c in deep.columns if c != "n_up")).unionByName(deep.where("pos >= n_up").drop("n_up"))
    buckets = max(1, -(-rows.count() // BUCKET))
    trie = dealt.withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets))).groupBy("bucket").applyInPandas(_forest, NODE + ", p1 long, p2 long")
    trie = settle(trie, "trie-nodes")
    return _joined(spark, trie, deep.where("pos < n_up"), whole).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(settle(turns(conversations), "trie-own")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_bound(df, BROADCAST_ROWS) else df


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conv_id -> a row a key: its smallest conv_id, how many, and the digest of all, made as they pass."""
    key, first, n, sha = None, None, 0, None
    done: list[tuple] = []
    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, first, n, sha.hexdigest()))
                key, first, n, sha = (k1, k2), conv, 1, hashlib.sha256(str(conv).encode())
            else:
                n += 1
                sha.update(b",%d" % conv)
        if done:
            yield _ended(done)
            done = []
    if key is not None:
        yield _ended([(*key, first, n, sha.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, conv, n, ends = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (k1, k2, conv, n)), pa.array(ends)], ["k1", "k2", "conv_id", "n", "ends"])


def _parted(deep: DataFrame) -> DataFrame:
    """Rows of oversized first turns with n_up, how many of a path's nodes are upper, and g1, g2, the key of the first node below them."""
    upper = settle(deep.groupBy("k1", "k2").agg(F.sum(F.expr("n_turns - pos")).alias("below")).where(F.col("below") > MOST).select("k1", "k2"), "trie-parted").withColumn("up", F.lit(1))
    path = Window.partitionBy("conv_id")
    out = deep.join(_small(upper), ["k1", "k2"], "left").withColumn("n_up", F.coalesce(F.sum("up").over(path), F.lit(0)).cast("int"))
    out = out.withColumns({f"g{i}": F.max(F.when(F.col("pos") == F.col("n_up"), F.col(f"k{i}"))).over(path) for i in (1, 2)})
    return settle(out.select("conv_id", "pos", "n_turns", "n_bytes", "h1", "h2", "k1", "k2", "n", "ends", "g1", "g2", "n_up"), "trie-deep")


def _forest(turn_rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of a bucket. Paths go in by conv_id, so a node is made by its smallest member, and after its parent."""
    tops: dict = {}
    children: list[dict] = []
    parent, conv_of, depth_of, n_convs, n_bytes, ends, above = [], [], [], [], [], [], []
    d = turn_rows.sort_values(["conv_id", "pos"])
    on, at = None, -1
    for conv, pos, k1, k2, h1, h2, n, size, end in zip(*(d[c].to_list() for c in ("conv_id", "pos", "k1", "k2", "h1", "h2", "n", "n_bytes", "ends"))):
        if conv != on:
            on, at = conv, -1
        beneath = tops if at < 0 else children[at]
        node = beneath.get((k1, k2))
        if node is None:
            node = beneath[k1, k2] = len(parent)
            children.append({})
            parent.append(at)
            conv_of.append(conv)
            depth_of.append(pos + 1)
            n_convs.append(0)
            n_bytes.append(size)
            ends.append(NO_ENDS)
            above.append((k1 ^ h1, k2 ^ h2) if at < 0 else (None, None))
        n_convs[node] += n
        if end is not None:
            ends[node] = end
        at = node
    leaves = [0 if c else 1 for c in children]
    saved = [(n - 1) * size for n, size in zip(n_convs, n_bytes)]
    for node in range(len(parent) - 1, -1, -1):  # postorder: what was made later lies deeper or beside
        if (p := parent[node]) >= 0:
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    out = {"conv_id": conv_of, "depth": depth_of, "parent_conv_id": [conv_of[p] if p >= 0 else None for p in parent], "n_convs": n_convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "p1": [a for a, _ in above], "p2": [b for _, b in above]}
    return pd.DataFrame({c: v if c == "ends_sha256" else pd.array(v, "Int64") for c, v in out.items()})


def _joined(spark, trie: DataFrame, over: DataFrame, whole: DataFrame) -> DataFrame:
    """Tries of parts, the upper nodes above them and the root, with the parents of each part's top."""
    tops, none = trie.where("p1 is not null"), F.lit(0).cast("long")
    xor = lambda i: F.min(F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}"))).alias(f"p{i}")
    nodes = over.groupBy("k1", "k2").agg((F.min("pos") + 1).cast("long").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("ends").alias("ends"), xor(1), xor(2))
    nodes = settle(nodes, "trie-upper")

    key = (F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
    values = nodes.select("conv_id", "depth", *key, ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), none.alias("leaves"))
    values = values.unionByName(tops.where("depth > 1").select("conv_id", "depth", *key, F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")))
    paths = over.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "k1", "k2", none.alias("saved"), none.alias("leaves"))
    from_here = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())  # with all of the same depth
    below = paths.unionByName(values).withColumns({c: F.sum(c).over(from_here) for c in ("saved", "leaves")}).where("k1 is not null")
    below = below.groupBy("k1", "k2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    children = nodes.select("p1", "p2").unionByName(tops.select("p1", "p2")).groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    upper = nodes.join(below, ["k1", "k2"]).join(children, ["k1", "k2"], "left")
    upper = settle(upper.select("k1", "k2", "conv_id", "depth", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "p1", "p2"), "trie-upper")

    first = tops.where("depth = 1").select("n_leaves", "saved_tokens").unionByName(upper.where("depth = 1").select("n_leaves", "saved_tokens"))
    total = first.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), none).alias("saved_tokens")).first()
    at_root: Column = F.when(F.expr("k1 = 0 and k2 = 0"), F.col("ends"))
    members = whole.agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("n"), none).alias("n"), F.coalesce(F.max(at_root), F.lit(NO_ENDS)).alias("ends")).first()
    root = [(members.conv_id, 0, None, members.n, total.n_children, total.n_leaves, total.saved_tokens, members.ends)] if members.n else []
    root = spark.createDataFrame(root, NODE)

    parents = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")).unionByName(root.select(none.alias("p1"), none.alias("p2"), F.col("conv_id").alias("above")))
    parents = settle(parents, "trie-parents")
    columns = [c for c in root.columns if c != "parent_conv_id"]
    heads = tops.select(*columns, "p1", "p2").unionByName(upper.select(*columns, "p1", "p2")).join(_small(parents), ["p1", "p2"])
    heads = heads.select(*columns, F.col("above").alias("parent_conv_id"))
    return trie.where("p1 is null").select(*root.columns).unionByName(heads).unionByName(root)


_ORDERED = """
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)"""
#: CRC-32 (polynomial 0xEDB88320) of a decimal number, which the second engine lacks.
CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))"
ORACLE = f"""WITH {_ORDERED},
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM r)),
t AS (SELECT c.conv_id, r.pos, role, text FROM c JOIN r ON r.conv_id = c.base AND r.pos < h UNION ALL SELECT c.conv_id, r.pos + 100000, role, text FROM c JOIN r ON r.conv_id = c.conv_id AND r.pos >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS k, octet_length(encode(text)) AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, k, lag(k, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS pk, size FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
e AS (SELECT arg_max(k, depth) AS k, conv_id FROM m GROUP BY conv_id),
n AS (SELECT m.k, min(m.conv_id) AS conv_id, any_value(depth) AS depth, any_value(pk) AS pk, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id), '')) AS ends_sha256 FROM m LEFT JOIN e ON e.k = m.k AND e.conv_id = m.conv_id GROUP BY m.k),
i AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT pk, count(*) AS n_children FROM n GROUP BY pk) x ON x.pk = n.k),
s AS (SELECT a.k, sum((b.n_convs - 1) * b.size) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM i a JOIN m ON m.k = a.k JOIN m mb ON mb.conv_id = m.conv_id AND mb.depth >= m.depth JOIN i b ON b.k = mb.k AND b.conv_id = mb.conv_id GROUP BY a.k)
SELECT i.conv_id, CAST(i.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(i.n_convs AS BIGINT) AS n_convs, CAST(i.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, i.ends_sha256
FROM i JOIN s USING (k) LEFT JOIN i q ON q.k = i.pk"""
