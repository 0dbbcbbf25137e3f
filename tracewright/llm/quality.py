"""Operator 6, quality rules: text statistics, then a learned decision list.

Sequential covering in the manner of RIPPER: conjunctions of thresholds are grown by information gain on one
part of the labelled rows that the base rule leaves and pruned on the other. A rule that is not precise enough is
put aside and covering goes on without what it covers. Then every rule is tried against one grown anew in its place
and one grown on from it, and the variant with the fewest errors of the whole list stays. The list is emitted in
order as one Spark conditional expression.

Defined results: a null text is an empty one; it has no words, so it fails the base rule. A null doc_id is
returned as such. Repeated rows each get their own row. Without labels of both classes the list is empty and
the base rule decides alone. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import hash_share, mapped, settle, small_batches

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_stops")
#: Bytes to delete so that only one class is left and len() counts it.
UPPER, LOWER, DIGITS, STOPS = (bytes(set(range(256)) - set(keep)) for keep in (range(65, 91), range(97, 123), range(48, 58), b".!?"))
#: Bytes that do not begin a code point.
TAILS = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words inside windows of n words that occur twice or more in the text, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(n))))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def dup_lines(lines: list[bytes]) -> int:
    full = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    return len(full) - len(set(full))


def stats_of(text: bytes) -> tuple[int, ...]:
    words, lines = text.split(), text.split(b"\n")
    n_chars = len(text.translate(None, TAILS))
    return (
        n_chars,
        len(words),
        n_chars - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")),
        sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(lines),
        dup_lines(lines),
        repeat_words(words),
        len(set(words)),
        *(len(text.translate(None, drop)) for drop in (UPPER, LOWER, DIGITS, STOPS)),
    )


def _stats(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        bodies = batch.column("body").cast(pa.binary()).to_pylist()
        rows = np.array([stats_of(x) for x in bodies], dtype=np.int64).reshape(len(bodies), len(COUNTS))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [*(f"own_{c}" for c in keep), *COUNTS])


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and COUNTS of every whole text, in one pass without a shuffle; of other columns those in ``keep`` go along, as own_<name>, since a count may have their name."""
    kept = ("doc_id", *(c for c in keep if c != "doc_id"))
    held = docs.select(*kept, F.coalesce("text", F.lit("")).alias("body"))
    schema = ", ".join([*(f"own_{c} {held.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} long" for c in COUNTS)])
    return mapped(held, lambda it: _stats(it, kept), schema).withColumnRenamed("own_doc_id", "doc_id")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


#: What rules may test.
FEATURES: dict[str, Column] = {}


def features() -> dict[str, Column]:
    if not FEATURES:
        FEATURES.update(
            words=F.col("n_words").cast("double"),
            word_length=_ratio("word_chars", "n_words"),
            symbols_per_word=_ratio("n_symbols", "n_words"),
            dup_lines=_ratio("n_dup_lines", "n_lines"),
            repeated=_ratio("n_repeat_words", "n_words"),
            distinct=_ratio("n_distinct_words", "n_words"),
            upper=_ratio("n_upper", "word_chars"),
            lower=_ratio("n_lower", "word_chars"),
            digits=_ratio("n_digits", "word_chars"),
            stops_per_word=_ratio("n_stops", "n_words"),
            words_per_line=_ratio("n_words", "n_lines"),
        )
    return FEATURES


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for t in rule:
        held &= t.holds(x)
    return held


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, within: np.ndarray, cuts: int) -> Test | None:
    """The threshold with the largest FOIL gain, half-way between neighbours at quantiles of the rows still covered."""
    p0, n0 = int(bad[within].sum()), int(within.sum())
    most, best = 1e-9, None
    for name, values in x.items():
        v, marked = values[within], bad[within]
        order = np.argsort(v, kind="stable")
        v, below = v[order], np.cumsum(marked[order])
        steps = np.flatnonzero(v[1:] > v[:-1])  # the last place of each value but the greatest
        if len(steps) > cuts:
            steps = steps[np.unique(np.linspace(0, len(steps) - 1, cuts).astype(int))]
        for i in steps.tolist():
            for above in (True, False):
                n1, p1 = (n0 - i - 1, p0 - int(below[i])) if above else (i + 1, int(below[i]))
                gain = p1 * (np.log2(p1 / n1) - np.log2(p0 / n0)) if p1 else 0.0
                if gain > most:
                    most, best = gain, Test(name, above, float((v[i] + v[i + 1]) / 2))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, within: np.ndarray, rule: Rule, cuts: int, most_tests: int) -> Rule:
    """rule with tests added as long as they gain and cover a good row less."""
    within = within & _covered(rule, x, len(bad))
    while len(rule) < most_tests and within.any() and not bad[within].all():
        test = _best_test(x, bad, within, cuts)
        if test is None:
            break
        rule, within = (*rule, test), within & test.holds(x)
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, rule: Rule) -> Rule:
    """The head of a rule that is worth most on rows it was not grown on: (bad - good) / covered, the shorter of equals."""

    def worth(r: Rule) -> float:
        held = _covered(r, x, len(bad)) & part
        n, p = int(held.sum()), int(bad[held].sum())
        return (2 * p - n) / max(n, 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 6), -len(r)), default=())


def _any_of(rules: list[Rule], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for r in rules:
        out |= _covered(r, x, n)
    return out


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, prune_part: np.ndarray, *, cuts: int = 64, most_tests: int = 4, least_precision: float = 0.9, least_cover: int = 5, most_rules: int = 24, passes: int = 2) -> list[Rule]:
    """Ordered conjunctions that tell bad rows from good ones; rows that none covers are good."""
    n, rules = len(bad), []

    def precise(rule: Rule, others: np.ndarray) -> bool:
        """Whether a rule does well on what others leave, on all rows and on those it was not grown on."""
        held = _covered(rule, x, n) & ~others
        apart = held & prune_part
        return held.sum() >= least_cover and bad[held].mean() >= least_precision and (not apart.any() or bad[apart].mean() >= least_precision)

    aside = np.zeros(n, bool)  # what rules that were put aside cover
    while len(rules) < most_rules:
        done = _any_of(rules, x, n)
        left = ~done & ~aside
        if (bad & left & ~prune_part).sum() < least_cover:
            break
        rule = _prune(x, bad, left & prune_part, _grow(x, bad, left & ~prune_part, (), cuts, most_tests))
        if not rule:
            break
        if precise(rule, done):
            rules.append(rule)
        else:
            covered = _covered(rule, x, n) & bad & left
            if not covered.any():
                break
            aside |= covered

    def errors(some: list[Rule]) -> int:
        return int((_any_of(some, x, n) != bad).sum())

    for _ in range(passes):
        for i, old in enumerate(rules):
            others = rules[:i] + rules[i + 1 :]
            left = ~_any_of(others, x, n)
            anew = _prune(x, bad, left & prune_part, _grow(x, bad, left & ~prune_part, (), cuts, most_tests))
            on = _grow(x, bad, left & ~prune_part, old, cuts, most_tests)
            tried = [r for r in (anew, on) if r and precise(r, ~left)]
            rules[i] = min([old, *tried], key=lambda r: (errors([*others[:i], r, *others[i:]]), len(r), r is not old))
        rules = [r for i, r in enumerate(rules) if errors(rules[:i] + rules[i + 1 :]) > errors(rules) or _covered(r, x, n)[bad & ~_any_of(rules[:i] + rules[i + 1 :], x, n)].any()]
    return rules


def fit(stats: DataFrame, chosen: DataFrame) -> list[Rule]:
    """The decision list learnt from the rows of ``chosen`` (see labelled) that have statistics and that the base rule leaves."""
    marked = chosen.withColumn("h", F.xxhash64("doc_id"))
    known = stats.where(~base_failed()).join(F.broadcast(marked), "doc_id").groupBy("doc_id", "h", "quality")  # one row for a doc_id, however often it stands in documents
    sample = known.agg(F.min(F.struct(*(c.alias(k) for k, c in features().items()))).alias("x")).select("h", "quality", "x.*").toPandas().sort_values(["h", *features()], ignore_index=True)
    bad = sample["quality"].to_numpy() == 0
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn_rules({k: sample[k].to_numpy() for k in features()}, bad, sample["h"].to_numpy() % 3 == 0)


def labelled(labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """doc_id and quality of about ``most_rows`` labelled rows at most, those first by a hash of doc_id: what the driver learns from is bounded by it."""
    marked = settle(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality-labels")
    return hash_share(marked, most_rows)


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that covers a row, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        held = F.lit(True)
        for t in rule:
            held = held & t.column()
        out = F.when(held, i) if out is None else out.when(held, i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """Statistics of every document with base_failed, rule and kept."""
    stats = settle(text_stats(docs), "quality-stats")
    return judge(stats, fit(stats, labelled(labels, most_rows=most_rows)))


def filtered(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """The rows of docs that are kept. Rules are learnt from the statistics of labelled rows alone, so every other text is read once."""
    chosen = labelled(labels, most_rows=most_rows)
    rules = fit(text_stats(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")), chosen)
    judged = judge(text_stats(docs, *docs.columns), rules).where("kept")
    return judged.select("doc_id", *(F.col(f"own_{c}").alias(c) for c in docs.columns if c != "doc_id")).select(*docs.columns)
