"""The append-only ledger: nudges with throttling, costs and errors of classification, surveyed sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.sources.scratch import cut

COST, ERROR = "classify_cost", "classify_error"


#: Events of a key that one task puts in order, and of a hot key's run that is folded as one array.
HOT, RUN = 1_000_000, 10_000


def throttle(df: DataFrame, keys: list[str], ts: str, minutes: int = V.THROTTLE_MINUTES) -> DataFrame:
    """Events that are logged: of each key the first, then each that comes at least so many minutes after the last one logged.

    The last *logged* event decides. An event that comes a gap after the event before it begins a run and is logged
    whatever came before, so runs are folded each on its own. Keys of more than HOT events, of which there are none among HOT rows, are
    split over tasks (see _split). Of events of one time one is logged.
    """
    rows = df.where(F.col(ts).isNotNull()).select(*keys, ts)
    gap = minutes * 60_000_000
    if gap <= 0:
        return rows
    kind = rows.schema[ts].dataType
    ntz = kind.typeName() == "timestamp_ntz"
    since = F.expr(f"cast(cast(cast(`{ts}` - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as bigint)")
    at = rows.select(*keys, (since if ntz else F.unix_micros(ts)).alias("t"))
    kept = _ordered(at, keys, gap)
    if rows.count() > HOT:
        hot = cut(at.groupBy(*keys).count().where(F.col("count") > HOT).select(*keys))
        cool = at.alias("a").join(hot.alias("b"), _equal(keys), "left_anti")
        kept = _ordered(cool, keys, gap).unionByName(_split(at.alias("a").join(hot.alias("b"), _equal(keys), "left_semi"), keys, gap))
    moment = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("t").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")) if ntz else F.timestamp_micros("t")
    return kept.select(*keys, moment.cast(kind).alias(ts))


def _folded(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Events (keys, run, t) -> those logged, folding each run's times as an array."""
    step = lambda acc, t: F.when(t >= F.element_at(acc, -1) + gap, F.concat(acc, F.array(t))).otherwise(acc)
    times = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_set("t")).alias("times"))
    return times.select(*keys, F.explode(F.aggregate("times", F.slice("times", 1, 1), step)).alias("t"))


def _ordered(at: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Events (keys, t) -> those logged, a key in one task: one shuffle."""
    by_key = Window.partitionBy(*keys).orderBy("t")
    begins = F.coalesce((F.col("t") - F.lag("t").over(by_key) >= gap).cast("int"), F.lit(1))
    return _folded(at.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_key.rowsBetween(Window.unboundedPreceding, 0))), keys, gap)


def _split(at: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Events (keys, t) -> those logged, a key in many tasks.

    Events are counted by key and bin, bins as wide as the gap, so at most one event of a bin is logged, and bins, not
    events, are put in order by key. A bin whose first event comes a gap after the bin before begins a run. Of runs
    with more than RUN events each event points to the first that comes a gap after it (found bin by bin), and
    pointers are doubled until the chain from the run's first event ends.
    """
    at = at.withColumn("bin", F.expr(f"(t - pmod(t, {gap}L)) div {gap}L"))
    by_key, run = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys, "run")
    bins = at.groupBy(*keys, "bin").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    begins = F.coalesce((F.col("first") - F.lag("last").over(by_key) >= gap).cast("int"), F.lit(1))
    bins = bins.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_key))
    bins = cut(bins.withColumns({"size": F.sum("n").over(run), "bins": F.count("*").over(run)}))
    alone = bins.where("bins = 1").select(*keys, F.col("first").alias("t"))
    dense = at.alias("a").join(bins.where("bins > 1").alias("b"), _equal([*keys, "bin"])).select(*(F.col(f"a.{k}") for k in keys), "run", "size", F.col("a.bin"), "t")
    return alone.unionByName(_folded(dense.where(F.col("size") <= RUN), keys, gap)).unionByName(_chained(dense.where(F.col("size") > RUN).drop("size"), keys, gap))


def _equal(keys: list[str], other: dict[str, str] | None = None) -> Column:
    """Whether a.key equals b.key for all keys (or what other names for b); null is a value."""
    return reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{(other or {}).get(k, k)}")) for k in keys))


def _chained(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The events (keys, run, bin, t) that are logged, by pointer doubling from the first one of each run."""
    run, none = [*keys, "run"], F.lit(None).cast("long")
    events = cut(events.distinct())
    firsts = events.groupBy(*run, "bin").agg(F.min("t").alias("t"))
    # a gap after an event of one bin lies in the next; what follows there, or first in the bin after it, is the successor
    offered = events.select(*run, "bin", "t", F.col("t").alias("event"), none.alias("asks")).unionByName(firsts.select(*run, (F.col("bin") - 1).alias("bin"), "t", F.col("t").alias("event"), none.alias("asks")))
    asked = events.select(*run, (F.col("bin") + 1).alias("bin"), (F.col("t") + gap).alias("t"), none.alias("event"), F.col("t").alias("asks"))
    downwards = Window.partitionBy(*run, "bin").orderBy(F.col("t").desc(), F.col("event").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = offered.unionByName(asked).withColumn("next", F.last("event", ignorenulls=True).over(downwards))
    after = cut(after.where("asks is not null and next is not null").select(*run, F.col("asks").alias("t"), "next"))
    logged = cut(events.groupBy(*run).agg(F.min("t").alias("t")))
    while not after.isEmpty():
        on = [F.col(f"a.{k}") for k in run]
        reached = logged.alias("a").join(after.alias("b"), _equal([*run, "t"])).select(*on, F.col("next").alias("t"))
        logged = cut(logged.unionByName(reached).distinct())
        after = cut(after.alias("a").join(after.alias("b"), _equal([*run, "next"], {"next": "t"})).select(*on, F.col("a.t"), F.col("b.next")))
    return logged.select(*keys, "t")


def entries_of_nudges(nudges: DataFrame) -> DataFrame:
    """Ledger entries of nudges that have a session and a kind."""
    return nudges.where("coalesce(session_id, '') <> '' and coalesce(kind, '') <> ''").select("ts", "session_id", "kind", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("category", F.lit("")).alias("category"))


def cost_entries(costs: DataFrame) -> DataFrame:
    """Ledger entries of classifications: what is no positive finite cost is 0."""
    cost = F.col("cost_usd").try_cast("double")
    good = (cost > 0) & ~F.isnan(cost) & (cost != float("inf"))
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    return costs.where("coalesce(session_id, '') <> ''").select("ts", "session_id", F.lit(COST).alias("kind"), F.when(good, cost).otherwise(0.0).alias("cost_usd"), blank("classifier"), blank("activity_category"), blank("domain"))


def error_entries(errors: DataFrame) -> DataFrame:
    return errors.select("ts", F.lit(ERROR).alias("kind"), F.left(F.coalesce(F.nullif("message", F.lit("")), F.lit("unknown")), F.lit(V.MESSAGE_CAP)).alias("message"))


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def nudges_shown(ledger: DataFrame, order: str = "line_no") -> DataFrame:
    """Per session the distinct kinds of nudges, as first seen; costs and errors are none."""
    shown = ledger.where(F.col("session_id").isNotNull() & ~F.col("kind").isin(COST, ERROR))
    first = shown.groupBy("session_id", "kind").agg(F.min(order).alias("o"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "kind"))), lambda x: x["kind"]).alias("nudges_shown"))


def latest(ledger: DataFrame, kind: str, order: str = "line_no") -> DataFrame:
    """The last entry of a kind in the file."""
    return ledger.where(F.col("kind") == kind).groupBy().agg(F.max_by(F.struct(*ledger.columns), order).alias("e")).where("e is not null").select("e.*")


def newer_error(ledger: DataFrame, order: str = "line_no") -> DataFrame:
    """The last error, if it is newer than the last success."""
    of = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col(order)))
    last = ledger.groupBy().agg(of(ERROR, "ts").alias("error_ts"), of(ERROR, "message").alias("message"), of(COST, "ts").alias("cost_ts"))
    return last.where("error_ts is not null and (cost_ts is null or error_ts > cost_ts)").select("error_ts", "message")


def remaining(ids: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct ids that a ledger does not hold."""
    return ids.distinct().join(done, ids.columns, "left_anti")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two ledgers of ids."""
    return a.unionByName(b).distinct()
