"""Functions of texts, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.regex import LONE, SPACE, java

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(x: Text, pattern: str) -> Column:
    return col(x).rlike(java(pattern))


def trim(x: Text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(col(x), f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _has(*parts: str) -> Callable[[Column], Column]:
    def sign(text: Column) -> Column:
        out = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            out = out | F.contains(text, F.lit(p))
        return out

    return sign


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


#: For each pattern of SECRET_PATTERNS and PII_PATTERNS what a text must have to match, found without the pattern. The
#: mark that takes the place of a match has none of it, so a sign of the first text holds for what becomes of it.
SIGNS = (
    _has("-----BEGIN "), _has("sk-"), _has("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _has("github_pat_"), _has("AKIA"), _has("xox"), _has("eyJ"), _has(":", "="),
    _like("[A-Fa-f0-9]{12}"), _like(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{40}"), _has("k_live_", "k_test_"), _has("ASIA"), _has("glpat-"),
    _has("@"), _like(r"[0-9]\.[0-9]"), _like(r"[0-9][0-9\s().\-]{7}"), _has("http"), _has("/"), _has(":\\"), _has("\\\\"), _like("[A-Z]{2}[0-9]{2}"),
)


def signed_patterns() -> list[tuple[str, Callable[[Column], Column]]]:
    """The patterns of secrets and personal data in order, each with its sign."""
    return list(zip((*V.SECRET_PATTERNS, *V.PII_PATTERNS), SIGNS, strict=True))


def scrub(x: Text) -> Column:
    """Secrets, then personal data, one pattern after the other, become a mark; white space collapses. Null becomes ''."""
    first = F.coalesce(col(x), F.lit(""))
    mark = V.REDACTED.replace("[", "\\[").replace("]", "\\]")
    held = F.array(first)
    for p, sign in signed_patterns():
        held = F.transform(held, _replacing(sign(first), java(p), mark))
    # a lone space stays as it is
    tidy = F.transform(held, lambda v: F.regexp_replace(v, f"{LONE}{SPACE}*| {SPACE}+", " "))
    return F.trim(F.get(tidy, F.lit(0)))


def _replacing(sign: Column, pattern: str, mark: str) -> Callable[[Column], Column]:
    return lambda v: F.when(sign, F.regexp_replace(v, pattern, mark)).otherwise(v)


def has_code(x: Text) -> Column:
    return matches(x, V.HAS_CODE[0]) | matches(x, V.HAS_CODE[1])


def words(x: Text) -> Column:
    return F.filter(F.split(trim(x), f"{SPACE}+"), lambda w: w != "")


def word_set(x: Text) -> Column:
    """Distinct lower-case runs of letters and digits, longer than two."""
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def ask_count(prompt: Text) -> Column:
    """Sentences with an imperative or items of a list, whichever are more."""
    sentences = F.filter(F.split(col(prompt), "[.!?\\n]+"), lambda s: matches(s, V.IMPERATIVE))
    items = F.regexp_count(col(prompt), F.lit(r"(?m)^\s*(?:\d+[.)]|[-*])\s+"))
    return F.greatest(F.size(sentences), items)


def sanitize_label(x: Text) -> Column:
    s = F.regexp_replace(trim(F.lower(F.coalesce(col(x), F.lit("")))), f"{SPACE}+", "-")
    s = F.left(F.regexp_replace(s, "[^a-z0-9._-]", ""), F.lit(40))
    return shaped(s, V.LABEL)


def shaped(x: Text, pattern: str) -> Column:
    """x if it has the shape, else ''."""
    return F.when(matches(x, pattern), col(x)).otherwise("")


def hmac12(salt: str, value: Text) -> Column:
    """The first 12 hex digits of HMAC-SHA256: two sha2 calls over pads made here."""
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(c ^ pad for c in key).hex())) for pad in (0x36, 0x5C))
    body = F.concat(inner, F.encode(F.coalesce(col(value).cast("string"), F.lit("")), "utf-8"))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(body, 256))), 256), 1, 12)


def counted(values: Column) -> Column:
    """Distinct values of an array that are not null, sorted, each with its number ``n``: one sort and one pass."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        ends = lambda at: F.slice(F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(s))), F.lit(1), F.size(at))
        return let(starts, lambda at: F.zip_with(at, ends(at), lambda a, b: F.struct(F.get(s, a).alias("value"), (b - a).alias("n"))))

    return let(F.array_sort(F.array_compact(values)), runs)


def first_case(pairs: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def listed(pairs: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)))


def count_where(array: Text, condition: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(col(array), condition))
