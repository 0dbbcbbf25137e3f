"""Connected components of a link table, by alternating large-star and small-star steps over settled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import settle


def _nearest(edges: DataFrame) -> DataFrame:
    """v, u -> v, u, m with m the least of v and all its neighbours."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
    return edges.join(least, "v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    near = _nearest(both)
    return near.where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    near = _nearest(down)
    out = near.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return out.union(near.select("v", F.col("m").alias("u"))).where("u <> v").distinct()


def components(links: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """node, component (its least node) of every node of links (a, b). Null ends and loops are left out."""
    edges = settle(links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("v"), F.col("b").alias("u")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        edges = settle(_small_star(_large_star(edges)), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_000_007)).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return out.union(out.select(F.col("component").alias("node"), "component").distinct())
