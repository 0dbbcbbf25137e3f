"""Spans of regular expressions in whole texts, with JVM-side functions alone.

Spark gives the matches of a pattern (regexp_extract_all) and what lies between them (split), but no places.
Matches and gaps alternate, so their lengths added up give every match its place in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,stop:int,text:string>"
#: Of a (kind, start, stop) in memory.
SPAN_BYTES = 56


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, what a match must satisfy, and a cheap sign without which no text can match."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    sign: str = "true"  #: SQL over the text


def with_spans(df: DataFrame, kinds: Sequence[Kind], text: str = "text") -> DataFrame:
    """df with a column ``spans_<kind>`` for each kind: its valid matches in order, leftmost first, never overlapping."""
    none = F.array().cast(f"array<{SPAN}>")
    found = {k.name: F.when(F.expr(k.sign), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for k in kinds}
    df = df.withColumns({f"found_{n}": c for n, c in found.items()})

    def places(k: Kind) -> Column:
        matches, gaps = F.col(f"found_{k.name}"), F.split(text, k.pattern, -1)
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("n")))

        def add(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            return F.struct((begin + p["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + p["n"]).alias("stop"), p["m"].alias("text")))).alias("out"))

        placed = F.aggregate(pairs, start, add, lambda acc: acc["out"])
        return F.when(F.size(matches) > 0, placed).otherwise(none)

    df = df.withColumns({f"spans_{k.name}": places(k) for k in kinds}).drop(*(f"found_{k.name}" for k in kinds))
    return df.withColumns({f"spans_{k.name}": _valid(k) for k in kinds if k.valid})


def _valid(k: Kind) -> Column:
    return F.filter(f"spans_{k.name}", lambda s: k.valid(s["text"]))


def _numbered(i: int, k: Kind) -> Column:
    return F.transform(f"spans_{k.name}", lambda s: F.struct(s["start"].alias("a"), F.lit(i).alias("b"), s["stop"].alias("stop"), F.lit(k.name).alias("kind")))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def flat(kinds: Sequence[Kind], by_start: bool) -> Column:
    """All spans as one array of (kind, start, stop): by kind as listed and then start, or by start and then kind."""
    parts = [_numbered(i, k) for i, k in enumerate(kinds)]
    rows = F.concat(*parts)
    if by_start:
        rows = F.array_sort(rows)
    return F.transform(rows, lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["stop"].alias("stop")))


def joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
