"""Operator 1, personal data: base patterns, then bootstrapped contextual extraction.

Base spans are seeds, each of its kind. What stands around a span or an identifier-like token (a token with
several digits) is a lexical pattern: two words on a side or one on each, and, backed off, one word with the
token's shape, the shapes of all three, or the token's shape alone. Contexts reach 48 characters (REACH) to either side. Patterns and instances make a bipartite graph that is scored in
turns: for each kind a pattern is worth the lower bound (Wilson) of the share of its distinct instances that are
believed so far (tokens that a kind's own test refutes, like numbers that fail Luhn's, are no instances of it), an instance the noisy-or of the patterns trusted for a kind. Instances believed enough count as
seeds of the next turn, so what one turn finds can induce patterns in the next. Trusted patterns then give the
tokens that no base pattern knows. The texts are read once; the turns run over aggregated edges.

Defined results: a null or empty text has no spans. A null doc_id is returned as such, and repeated rows each
get their own row, since rows are told apart by a number of their own. Columns other than doc_id and text are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checked, settle, texts
from tracewright.llm.spans import SPAN_BYTES, Kind, count_of, flat, joined, with_spans

#: Possessive where nothing that follows could take back what was matched, so that long runs need no stack.
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", sign="contains(text, '@')"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(OCTETS), "rlike(text, '[0-9][.][0-9]')"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", lambda m: _digits(m).between(16, 19) & F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")), "rlike(text, '[0-9][ 0-9-]{14}')"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _digits(m).between(8, 15), "contains(text, '+')"),
)
#: Identifier-like tokens: six characters or more with four digits or more.
TOKENS = Kind("token", r"(?<![A-Za-z0-9])(?=[A-Za-z/.-]*+[0-9])[A-Za-z0-9]++(?:[-/.][A-Za-z0-9]++)*+", lambda m: (F.length(m) >= 6) & (_digits(m) >= 4), "rlike(text, '[0-9]')")
#: As far as contexts reach, in characters.
REACH = 48


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _shape(x: Column, digits: str) -> Column:
    """Letters, digits and repeated signs each collapsed to one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\p{L}+", "a"), digits, "9"), r"([^\p{L}0-9])\1+", "$1")


def _contexts(text: Column, s: Column) -> Column:
    """The patterns of a span: two words before it, one on each side, two after it; one word and its own shape; the shapes of both words and its own; its own alone."""
    before = F.lower(F.substring(text, F.greatest(s["start"] - REACH + 1, F.lit(1)), F.least(s["start"], F.lit(REACH))))
    after = F.lower(F.substring(text, s["stop"] + 1, F.lit(REACH)))
    left2 = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    left1, right1 = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1)
    right2 = F.regexp_extract(after, r"^\s*(\S+\s+\S+)", 1)
    own = _shape(F.regexp_replace(F.lower(s["text"]), "[0-9]{4}", "#"), "[0-9]+")  # four digits at a time: long numbers keep their length
    wide = lambda x: _shape(x, "[0-9]+")
    patterns = F.array(
        F.when(left2 != "", F.concat(F.lit("ll "), left2)),
        F.when((left1 != "") & (right1 != ""), F.concat_ws(" ", F.lit("lr"), left1, right1)),
        F.when(right2 != "", F.concat(F.lit("rr "), right2)),
        F.when(left1 != "", F.concat_ws(" ", F.lit("l"), left1, own)),
        F.when(right1 != "", F.concat_ws(" ", F.lit("r"), own, right1)),
        F.concat_ws(" ", F.lit("s"), wide(left1), own, wide(right1)),
        F.concat(F.lit("o "), own),
    )
    return F.array_compact(patterns)


def extract(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """row, doc_id, base (array of kind, start, stop) and items: seeds (with their kind) and candidates (with none) with their patterns. No shuffle."""
    spans = with_spans(texts(docs).withColumn("row", F.monotonically_increasing_id()), (*kinds, TOKENS))
    spans = spans.withColumn("base", flat(kinds, by_start=False))
    free = F.filter("spans_token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))

    def as_items(found: Column | str, kind: str | None) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"], s["stop"], s["text"], F.lit(kind).cast("string").alias("seed")))

    spans = spans.withColumn("found", F.concat(*(as_items(f"spans_{k.name}", k.name) for k in kinds), as_items(free, None)))
    items = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lower(s["text"]).alias("instance"), s["seed"].alias("seed"), _contexts(F.col("text"), s).alias("patterns")))
    return spans.select("row", "doc_id", "base", items.alias("items"))


def lower_bound(k: Column, n: Column, z: float) -> Column:
    """Of a share k / n, the end of its Wilson interval that is on the safe side."""
    p, zz = k / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)


def bootstrap(items: DataFrame, *, turns: int = 3, trust: float = 0.5, least: int = 5, z: float = 1.64) -> DataFrame:
    """Trusted patterns (pattern, kind, belief) of a pattern-instance graph over items (instance, seed, pattern).

    A pattern needs ``least`` believed instances and a majority of all its instances that is no chance: with
    the bound at 1.64 and trust at 0.5 five of five, fourteen of twenty, fifty-nine of a hundred. Unseen identifiers
    count against it until a turn has found them.
    """
    edges = items.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = settle(edges.withColumn("refuted", F.when(F.col("seed").isNull(), refuted("instance")).otherwise(F.array().cast("array<string>"))), "pii-edges")
    out = F.create_map(*(x for k in KINDS for x in (F.lit(k.name), F.count_if(F.array_contains("refuted", k.name)))))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("all"), out.alias("out"))
    sure = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("k"))
    open_ = edges.where("seed is null").select("pattern", "instance", "refuted")
    trusted = None
    for turn in range(turns):
        told = sure
        if turn:
            # candidates that trusted patterns vouch for are seeds from now on, weighed by belief
            heard = open_.join(few(trusted, "pattern"), "pattern").where(~F.array_contains("refuted", F.col("kind"))).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("belief"))))).alias("belief"))
            heard = settle(heard.where(F.col("belief") >= trust).groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"), F.max("belief").alias("belief")), "pii-heard")
            told = sure.union(open_.join(few(heard, "instance"), "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("k"))).groupBy("pattern", "kind").agg(F.sum("k").alias("k"))
        # k alone bounds the worth from above: most patterns go before they meet their sizes
        told = told.where((F.col("k") >= least) & (lower_bound(F.col("k"), F.col("k"), z) >= trust))
        trusted = told.join(sizes, "pattern").withColumn("n", F.col("all") - F.col("out")[F.col("kind")]).withColumn("belief", lower_bound(F.col("k"), F.col("n"), z))
        trusted = settle(trusted.where(F.col("belief") >= trust).select("pattern", "kind", "belief"), "pii-trusted")
    return trusted


def few(df: DataFrame, key: str) -> DataFrame:
    """df, a pattern or an instance a row, broadcast if its bytes are few."""
    return checked(df, 64 + F.octet_length(key))


def refuted(instance: str | Column) -> Column:
    """The kinds whose pattern an instance matches as a whole while it fails their test: it is certainly none of them, and says nothing about their patterns."""
    c = F.col(instance) if isinstance(instance, str) else instance
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(*(F.when(c.rlike(rf"\A(?:{k.pattern})\z") & ~k.valid(c), F.lit(k.name)).otherwise(none) for k in KINDS if k.valid)))


def graph(rows: DataFrame) -> DataFrame:
    """row, start, stop, instance, seed and pattern, one row for each pattern of an item."""
    return rows.select("row", F.explode("items").alias("i")).select("row", "i.*").withColumn("pattern", F.explode("patterns")).drop("patterns")


def find_pii(docs: DataFrame, *, turns: int = 3, trust: float = 0.5) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, stop) of every row; the kind of an added span is context-<kind of its patterns>."""
    rows = settle(extract(docs), "pii-rows")
    items = graph(rows)
    trusted = bootstrap(items.select("instance", "seed", "pattern"), turns=turns, trust=trust)
    found = items.where("seed is null").join(few(trusted, "pattern"), "pattern").where(~F.array_contains(refuted("instance"), F.col("kind"))).groupBy("row", "start", "stop", "kind").agg(F.sum(F.log1p(-F.col("belief"))).alias("doubt"))
    found = found.groupBy("row", "start", "stop").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind"))
    found = settle(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("context-"), "kind").alias("kind"), "start", "stop"))).alias("added")), "pii-added")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return rows.select("row", "doc_id", "base").join(checked(found, 64 + 2 * SPAN_BYTES * F.size("added")), "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def masked(docs: DataFrame, *, turns: int = 3, trust: float = 0.5) -> DataFrame:
    """How well patterns find seeds that were hidden: kind, hidden (instances: a third by hash), found (of them, with their kind), claimed (candidates and hidden ones given that kind)."""
    items = graph(settle(extract(docs), "pii-rows")).select("instance", F.col("seed").alias("truth"), "pattern").distinct()
    hide = F.pmod(F.xxhash64("instance"), F.lit(3)) == 0
    items = settle(items.withColumn("seed", F.when(~hide, F.col("truth"))), "pii-masked")
    trusted = bootstrap(items.select("instance", "seed", "pattern"), turns=turns, trust=trust)
    said = items.where("seed is null").join(few(trusted, "pattern"), "pattern").where(~F.array_contains(refuted("instance"), F.col("kind"))).groupBy("instance", "truth", "kind").agg(F.sum(F.log1p(-F.col("belief"))).alias("doubt"))
    said = said.groupBy("instance", "truth").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind"))
    asked = items.where("truth is not null and seed is null").select("instance", "truth").distinct().groupBy(F.col("truth").alias("kind")).agg(F.count("*").alias("hidden"))
    told = said.groupBy("kind").agg(F.count_if(F.col("kind") == F.col("truth")).alias("found"), F.count("*").alias("claimed"))
    return asked.join(told, "kind", "left").na.fill(0)


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The contract's columns."""
    counts = {f"n_{k.name}": count_of("base", k.name) for k in kinds}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
