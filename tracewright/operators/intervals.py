"""Points within spans of the same key, joined or summed up by bins of time: a key that holds most rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the narrowest bin, how much wider each level's bins are than those of the level before, and how many levels there are.
BIN_S, WIDER, LEVELS = 7200, 8, 6


def _bin(at: Column, level: Column | int, bin_s: int) -> Column:
    width = F.pow(F.lit(float(WIDER)), level if isinstance(level, Column) else F.lit(level)) * (bin_s * 1_000_000)
    return F.floor(F.unix_micros(at) / width)


def within(points: DataFrame, spans: DataFrame, by: str, at: Column | str, begin: Column | str, end: Column | str, *, bin_s: int = BIN_S) -> DataFrame:
    """Pairs (p, s: rows as structs) of a point and a span of one key where begin <= at <= end. Rows with a null there, and spans that end before they begin, have no pair.

    A span lies in the level whose bins are as wide as it is long, so in two bins at most (beyond the widest bins, some 7 years, in
    as many as it is long); a point lies in one bin of each level. Key, level and bin are the join's key.
    """
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("timestamp")
    t, a, b = c(at), c(begin), c(end)
    length = F.unix_micros(b) - F.unix_micros(a)
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(length <= bin_s * 1_000_000 * WIDER**i, i).otherwise(level)
    p = points.where(F.col(by).isNotNull() & t.isNotNull()).select(F.col(by).alias("key"), t.alias("t"), F.struct("*").alias("p"))
    p = p.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("bin", _bin(F.col("t"), F.col("level"), bin_s))
    s = spans.where(F.col(by).isNotNull() & (a <= b)).select(F.col(by).alias("key"), a.alias("a"), b.alias("b"), level.alias("level"), F.struct("*").alias("s"))
    s = s.withColumn("bin", F.explode(F.sequence(_bin(F.col("a"), F.col("level"), bin_s), _bin(F.col("b"), F.col("level"), bin_s))))
    return p.join(s, ["key", "level", "bin"]).where("t between a and b").select("p", "s")


def _widths(unit_us: int) -> list[int]:
    """Widths of bins in microseconds, each at most WIDER times the one before: powers of WIDER, then multiples of the unit."""
    fine = [WIDER**i for i in range(40) if WIDER**i < unit_us]
    return [*fine, *(unit_us * WIDER**i for i in range(20) if unit_us * WIDER**i < 1 << 57)]


def summed(points: DataFrame, spans: DataFrame, by: str, at: Column | str, begin: Column | str, end: Column | str, span: str, value: str, *, unit_us: int = 3_600_000_000) -> DataFrame:
    """span, n, least, greatest: of each span (``span`` tells them apart) that holds a point of its key, begin <= at <= end, how many it holds and the least and greatest value there. What within would give is not made: pairs grow with points times spans.

    A span takes the widest bins that are no longer than it is, so its ends lie in two bins: it holds the later part of one, the
    earlier part of the other, and the bins between (less than WIDER) whole. Parts are running sums within a bin, in both directions. A point lies in
    one bin of each level that a span takes; spans as long as unit_us (what most are) have no bin between.
    """
    us = lambda x: F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))
    widths = _widths(unit_us)
    width = F.element_at(F.array(*(F.lit(w).cast("long") for w in widths)), F.col("level") + 1)
    bin_of = lambda t: F.floor((F.col(t) - F.pmod(F.col(t), width)) / width).cast("long")
    level = F.lit(0)
    for i, w in enumerate(widths[1:], 1):
        level = F.when(F.col("b") - F.col("a") >= w, i).otherwise(level)
    s = spans.where(F.col(by).isNotNull()).select(F.col(span).alias("span"), F.col(by).alias("key"), us(begin).alias("a"), us(end).alias("b")).where("a <= b")
    s = s.withColumn("level", level).withColumns({"first": bin_of("a"), "last": bin_of("b")})
    p = points.where(F.col(by).isNotNull()).select(F.col(by).alias("key"), us(at).alias("t"), F.col(value).alias("value")).where("t is not null")
    p = p.join(F.broadcast(s.select("level").distinct())).withColumn("bin", bin_of("t"))  # as many levels as there are widths

    of = ["key", "level", "bin"]
    edge = lambda kind, t, bin_: F.struct(F.lit(kind).alias("kind"), F.col(t).alias("t"), F.col(bin_).alias("bin"))
    edges = s.where("first < last").select("span", "key", "level", F.explode(F.array(edge(0, "a", "first"), edge(2, "b", "last"))).alias("e")).select("span", "key", "level", "e.*")
    rows = p.withColumn("kind", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    sums = lambda w: F.struct(F.count_if(F.col("kind") == 1).over(w).alias("n"), F.min("value").over(w).alias("least"), F.max("value").over(w).alias("greatest"))
    to_here = lambda *order: Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"before": sums(to_here("t", "kind")), "after": sums(to_here(F.desc("t"), F.desc("kind")))})
    parts = rows.where("kind <> 1").select("span", F.when(F.col("kind") == 0, F.col("after")).otherwise(F.col("before")).alias("x"))

    whole = p.groupBy(*of).agg(F.struct(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest")).alias("x"))
    between = F.when(F.col("first") == F.col("last"), F.array("first")).when(F.col("first") + 1 < F.col("last"), F.sequence(F.col("first") + 1, F.col("last") - 1))
    held = s.select("span", "key", "level", F.explode(between).alias("bin")).join(whole, of).select("span", "x")
    return parts.unionByName(held).groupBy("span").agg(F.sum("x.n").alias("n"), F.min("x.least").alias("least"), F.max("x.greatest").alias("greatest")).where("n > 0")
