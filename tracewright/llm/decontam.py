"""Operator 3, benchmark decontamination: MinHash containment search, JVM-side throughout.

Containment of an item in a document is the share of the item's distinct 5-word shingles that the document has.
Sides differ in size by orders of magnitude. Of an item with s shingles at most s - ceil(0.75 s) can be missing, so one
of its s - ceil(0.75 s) + 1 least hashes (its MinHash values under one permutation, the bottom-k form) is in every
document that contains it. Items are partitioned by size, in powers of two. The greatest hash in the sketches of a
partition is the bound up to which documents are sketched for it, and its least need is the size from which a
document is: a document's sketch is its hashes up to the largest bound of the partitions that it has room for. Nothing
is lost, however long a document is. Candidates are verified by their shingles as words.

Defined results: a null or empty text, or one shorter than any item, contains nothing. An item with fewer than
five words is one shingle of all its words, looked for among runs of as many words; an item without words is
contained nowhere. Rows with a null doc_id or item_id are left out, since a pair needs both. Repeated rows give
one pair. Columns other than the ids and texts are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import rows_bound, settle

WORDS = 5
#: The items' sketches are broadcast only up to so many hashes (about 16 MB, and some four times as many shingles); beyond, they meet the documents by a shuffle.
BROADCAST_ROWS = 500_000
#: Items whose shingles one row holds when a document is verified.
ASKED = 256


def words(text: str | Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def runs(n_words: Column, n: int) -> Column:
    """Places of runs of n words, from 1; none if there are fewer words."""
    return F.when(n_words >= n, F.sequence(F.lit(1), n_words - n + 1)).otherwise(F.array().cast("array<int>"))


def hashed(w: Column, n: int) -> Column:
    return F.transform(runs(F.size(w), n), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(n))))


def spelled(w: Column, n: int) -> Column:
    return F.array_distinct(F.transform(runs(F.size(w), n), lambda i: F.array_join(F.slice(w, i, n), " ")))


def item_sketches(items: DataFrame, least: float = 0.75, n: int = WORDS) -> DataFrame:
    """item_id, run (words in a shingle), shingles, need (to be shared), size_class (its partition) and sketch (its least hashes) of every item with words."""
    base = items.where("item_id is not null").select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0).distinct()
    run = F.least(F.size("w"), F.lit(n))
    by_run = [F.when(run == k, hashed(F.col("w"), k)) for k in range(1, n)]
    spell = [F.when(run == k, spelled(F.col("w"), k)) for k in range(1, n)]
    base = base.select("item_id", run.alias("run"), F.coalesce(*by_run, hashed(F.col("w"), n)).alias("h"), F.coalesce(*spell, spelled(F.col("w"), n)).alias("shingles"))
    base = base.withColumn("h", F.array_sort(F.array_distinct("h"))).withColumn("need", F.ceil(F.size("shingles") * F.lit(least)).cast("int"))
    base = base.withColumn("size_class", F.floor(F.log2(F.size("shingles"))).cast("int"))
    return base.withColumn("sketch", F.slice("h", 1, F.size("h") - F.ceil(F.size("h") * F.lit(least)).cast("int") + 1)).drop("h")


def size_partitions(sketches: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """By run: (least need, greatest hash of a sketch) of every partition of items by size; 64 a run at most."""
    rows = sketches.groupBy("run", "size_class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("bound")).collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["run"], r["size_class"])):
        out.setdefault(r["run"], []).append((r["need"], r["bound"]))
    return out


def document_sketches(worded: DataFrame, n: int, partitions: list[tuple[int, int]]) -> DataFrame:
    """doc_id, n_runs and h: the hashes of a document's runs of n words up to the largest bound of the partitions that it has room for."""
    sized = worded.withColumn("n_runs", F.size("w") - n + 1).where(F.col("n_runs") >= min(need for need, _ in partitions))
    bound = F.greatest(*(F.when(F.col("n_runs") >= need, F.lit(bound)) for need, bound in partitions), F.lit(None).cast("long"))
    return sized.select("doc_id", "n_runs", F.explode(F.filter(hashed(F.col("w"), n), lambda h: h <= bound)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, *, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair with a containment of ``least`` or more."""
    sketches = settle(item_sketches(items, least), "item-sketches")
    partitions = size_partitions(sketches)
    probes = sketches.select("item_id", "run", "need", F.explode("sketch").alias("h"))
    small = rows_bound(probes, BROADCAST_ROWS)
    body = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    worded = body.select("doc_id", words("text").alias("w"))
    found = None
    for n, parts in partitions.items():
        sketch = probes.where(F.col("run") == n).drop("run")
        part = document_sketches(worded, n, parts).join(F.broadcast(sketch) if small else sketch, "h").where("n_runs >= need").select("doc_id", "item_id").distinct()
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item int, n_shared int, containment double")
    candidates = settle(found, "item-candidates")
    asked = candidates.join(F.broadcast(sketches) if small else sketches, "item_id").select("doc_id", "item_id", "run", "shingles")
    # a row holds the shingles of ASKED items at most, whatever a document contains
    nth = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("item_id"))
    per_doc = asked.withColumn("part", F.floor((nth - 1) / ASKED)).groupBy("doc_id", "run", "part").agg(F.collect_list(F.struct("item_id", "shingles")).alias("asked"))
    held = body.join(per_doc, "doc_id").withColumn("w", words("text"))
    shingles = F.coalesce(*(F.when(F.col("run") == n, spelled(F.col("w"), n)) for n in partitions))
    held = held.select("doc_id", shingles.alias("own"), "asked")
    counted = held.select("doc_id", F.explode(F.transform("asked", lambda a: F.struct(a["item_id"].alias("item_id"), F.size(a["shingles"]).alias("n_item"), F.size(F.array_intersect("own", a["shingles"])).alias("n_shared")))).alias("x"))
    share = F.col("x.n_shared") / F.col("x.n_item")
    return counted.select("doc_id", "x.item_id", "x.n_item", "x.n_shared", share.alias("containment")).where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(least))).distinct()


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM x JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.75)
"""
