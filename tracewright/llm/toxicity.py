"""Operator 4, toxicity by maximal scoring segments.

Tokens get log-odds of the toxic class against the other, with an informative Dirichlet prior (the share of
each token in both), and so do stems, which are the first letters that tokens share: many languages spell a word in more
forms than are seen often enough. A token without a weight of its own has that of its longest stem. Tokens that do
not differ significantly, and unknown ones, get a small negative score, so a text drifts down but for toxic passages. One linear scan finds all maximal scoring segments. A segment's
score has the extreme-value law of Karlin and Altschul: E = K n exp(-lambda s) segments as good are expected in
n clean tokens; lambda comes from the scores of clean tokens, K from segments of clean documents. A document's
evidence is the sum of -log E over its significant segments, turned to a probability by a logistic fit. Lambda, K and the
fit are learnt from rows scored with weights that other rows gave.

Labels are learnt from at most ``most_rows`` labelled rows that are not held out, the first by a hash of
doc_id; scores depend on the text alone. Defined results: a null or empty text has no segment and gets the
score of no evidence. Without labels of both classes every score is the share of toxic labels (0 without any).
A null doc_id is returned as such and is not held out. Repeated rows each get their own row. Columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import columns, hash_share, held_out, mapped, settle, small_batches, texts

TRIM = b" .,;:!?|&$#%*()[]{}<>\"'`~^=+/\\-_"


def token_of(chunk: bytes) -> bytes:
    """A white-space chunk without its outer punctuation, A-Z in lower case."""
    return chunk.strip(TRIM).lower()


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)  #: of the tokens that differ
    stems: dict[str, float] = field(default_factory=dict)  #: of the stems that differ
    drift: float = 0.5  #: what any token costs
    rate: float = 1.0  #: lambda
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -9.0
    most_e: float = 0.05  #: a segment is significant below this E


#: Letters of the shortest and the longest stem. A token is longer than its stems.
STEM = 4, 12


class _Scores(dict):
    """chunk -> score, for as many chunks as fit."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.heads = {x[: STEM[0]] for x in model.stems}

    def weight(self, token: bytes) -> float:
        found = self.model.weights.get(token)
        if found is None and self.heads:
            # enough bytes for the longest stem and one letter more
            word = token[: 4 * STEM[1] + 4].decode("utf-8", "replace")
            if word[: STEM[0]] in self.heads:
                stems = (word[:k] for k in range(min(len(word) - 1, STEM[1]), STEM[0] - 1, -1))
                found = next((self.model.stems[x] for x in stems if x in self.model.stems), None)
        return found or 0.0

    def __missing__(self, chunk: bytes) -> float:
        score = self.weight(token_of(chunk)) - self.model.drift
        if len(self) < 500_000:
            self[chunk] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), left to right, in linear time.

    Only positive tokens can begin or end one, so the scan visits those, with running sums before and after
    each. A list keeps the candidates; each knows the nearest earlier one that began lower.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    found: list[list] = []  # start, stop, sum before, sum after, index of the nearest candidate that began lower
    for i in at:
        after = float(total[i])
        start, before = int(i), after - float(scores[i])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append([start, int(i) + 1, before, after, j])
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
            j = j - 1
    return [(a, b, y - x) for a, b, x, y, _ in found]


def evidence(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
    """The document's evidence and its significant segments with their E."""
    out, total = [], 0.0
    for a, b, s in found:
        e = model.k * max(n, 1) * math.exp(-model.rate * s)
        if e < model.most_e:
            out.append((a, b, s, e))
            total -= math.log(max(e, 1e-300))
    return total, out


def probability(model: Model, x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.intercept + model.slope * x))))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token with a hash of the token before it, the class, the least document and the folds, once for a batch.

    Distinct contexts are what is counted: a word of a text that was copied many times has one, a word that is
    used many times has many.
    """
    for batch in small_batches(batches):
        rows: dict[tuple, list[int]] = {}
        for doc, body, toxic, fold in zip(*columns(batch), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
            tokens = [t for c in body.split() if (t := token_of(c))]
            for key in set(zip(tokens, map(zlib.crc32, [b"", *tokens]), repeat(toxic))):
                seen = rows.setdefault(key, [doc, 0])
                seen[0] = min(seen[0], doc)
                seen[1] |= 1 << fold
        flat = [(*key, *seen) for key, seen in rows.items()]
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        cells = list(zip(*flat)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds)], ["token", "before", "toxic", "doc_id", "folds"])


def _counted(rows: DataFrame, folds: int, least_docs: int) -> DataFrame:
    """Contexts of tokens and stems by class, over all rows (clean, toxic, docs) and over those outside each fold (clean_0, ...).

    ``docs`` are toxic documents, where texts copied from each other count as one. Only what stands in least_docs of them is
    returned, and the stem of no letters, which has the totals.
    """
    used = mapped(rows, _contexts, "token binary, before long, toxic int, doc_id long, folds int").groupBy("token", "before", "toxic").agg(F.min("doc_id").alias("doc_id"), F.bit_or("folds").alias("folds"))
    views = {"": F.lit(True)} | {f"_{k}": F.col("folds").bitwiseAND(((1 << folds) - 1) ^ (1 << k)) != 0 for k in range(folds)}
    sides = [x + v for v in views for x in ("clean", "toxic")]
    count = [F.count_if((F.col("toxic") == int(x == "toxic")) & seen).alias(x + v) for v, seen in views.items() for x in ("clean", "toxic")]
    # clean documents are not told apart
    per_doc = used.groupBy("token", F.when(F.col("toxic") == 1, F.col("doc_id")).alias("doc")).agg(*count)
    word = F.col("token").cast("string")
    lengths = F.array_insert(F.filter(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda k: k < F.char_length(word)), 1, F.lit(0))
    stems = F.transform(lengths, lambda k: F.struct(F.substring(word, F.lit(1), k).cast("binary").alias("token"), F.lit(True).alias("stem")))
    own = F.array(F.struct("token", F.lit(False).alias("stem")))
    spread = per_doc.select(F.explode(F.concat(own, stems)).alias("x"), "doc", *sides).select("x.*", "doc", *sides)
    summed = spread.groupBy("token", "stem", "doc").agg(*(F.sum(c).alias(c) for c in sides))
    docs = [F.count_if(F.col(f"toxic{v}") > 0).alias(f"docs{v}") for v in views]
    return summed.groupBy("token", "stem").agg(*(F.sum(c).alias(c) for c in sides), *docs).where((F.col("docs") >= least_docs) | (F.length("token") == 0))


def weigh(clean: np.ndarray, toxic: np.ndarray, n0: float, n1: float, *, prior: float = 500.0, least_g: float = 15.0) -> np.ndarray:
    """Log-odds with a Dirichlet prior of ``prior`` pseudo-counts, of n0 clean and n1 toxic uses; 0 unless the likelihood ratio G is least_g."""
    a = prior * (clean + toxic) / max(n0 + n1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log((toxic + a) / (n1 + prior - toxic - a)) - np.log((clean + a) / (n0 + prior - clean - a))
        both = (clean + toxic) / (n0 + n1)
        g = 2 * (np.nan_to_num(toxic * np.log(toxic / (both * n1))) + np.nan_to_num(clean * np.log(clean / (both * n0))))
    return np.where(g >= least_g, np.nan_to_num(delta), 0.0)


def _learn(model: Model, table, view: str, least_docs: int) -> Model:
    """The model with the signed weights of one view of the counts; what leans to toxic by less than the drift keeps none."""
    total = table[table["stem"] & (table["token"].map(len) == 0)]
    n0, n1 = float(total[f"clean{view}"].sum()), float(total[f"toxic{view}"].sum())
    if not n0 or not n1:
        return replace(model, weights={}, stems={})
    some = table[(table[f"docs{view}"] >= least_docs) & (table["token"].map(len) > 0)]
    found = weigh(some[f"clean{view}"].to_numpy(float), some[f"toxic{view}"].to_numpy(float), n0, n1)
    good = [(bytes(t), stem, float(w)) for t, stem, w in zip(some["token"], some["stem"], found) if w > model.drift or w < 0]
    return replace(model, weights={t: w for t, stem, w in good if not stem}, stems={t.decode("utf-8", "replace"): w for t, stem, w in good if stem})


def _root(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1, by bisection; 1 if there is none."""
    p = counts / counts.sum()
    if values.max(initial=-1) <= 0 or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little ridge."""
    w, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b + w * x, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-3 * w, (p - y).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum()]])
        step = np.linalg.solve(h, g)
        w, b = w - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(w), float(b)


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 12_000, least_docs: int = 3, folds: int = 3) -> Model:
    """A model from about most_rows labelled rows at most that are not held out, those first by a hash of doc_id."""
    model = Model()
    marked = settle(labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    chosen = hash_share(marked, most_rows)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int")
    rows = settle(texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("fold", fold), "toxic-rows")  # chosen is bounded by most_rows
    table = _counted(rows, folds, least_docs).toPandas()
    total = table[table["token"].map(len) == 0]
    if not total["toxic"].sum() or not total["clean"].sum():
        share = chosen.agg(F.avg("toxic")).first()[0] or 0.0
        model.intercept = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    apart = [_learn(model, table, f"_{k}", least_docs) for k in range(folds)]
    model = _learn(model, table, "", least_docs)
    seen = mapped(rows, lambda it: _learn_rows(it, apart), "toxic int, n long, scores array<double>, hits array<double>").toPandas()
    clean = seen[seen["toxic"] == 0]
    hits, times = np.unique(np.concatenate([*clean["hits"], np.zeros(0)]), return_counts=True)
    n = int(clean["n"].sum())
    model.rate = _root(np.r_[hits, -model.drift], np.r_[times, max(n - times.sum(), 1)].astype(float))
    # E of a segment of a clean document of mean length, averaged, should be what is seen
    best = np.array([s for row in clean["scores"] for s in row])
    edge = float(np.quantile(best, 0.5)) if len(best) else 0.0
    model.k = max(float((best >= edge).sum()), 0.5) / (max(n, 1) * math.exp(-model.rate * edge))
    x = np.array([evidence(model, [(0, 0, s) for s in row], k)[0] for row, k in zip(seen["scores"], seen["n"])])
    model.slope, model.intercept = _logistic(x, seen["toxic"].to_numpy(float))
    return model


def _learn_rows(batches: Iterator[pa.RecordBatch], apart: list[Model]) -> Iterator[pa.RecordBatch]:
    """Rows scored with the weights that the other folds gave."""
    known = [_Scores(m) for m in apart]
    for batch in small_batches(batches):
        ns, found, hits = [], [], []
        for body, fold in zip(columns(batch)[1], batch.column("fold").to_pylist()):
            words = body.split()
            s = np.fromiter(map(known[fold].__getitem__, words), np.float64, len(words))
            ns.append(len(words))
            found.append([x[2] for x in segments(s)])
            hits.append([round(float(v), 6) for v in s[s > 0]])
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(ns, pa.int64()), pa.array(found, kind), pa.array(hits, kind)], ["toxic", "n", "scores", "hits"])


SEGMENTS = "array<struct<start:int,stop:int,score:double,e:double>>"


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known = _Scores(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))
    for batch in small_batches(batches):
        ids, bodies = columns(batch)
        words = [b.split() for b in bodies]
        ends = np.cumsum([0, *map(len, words)])
        scores = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.float64, int(ends[-1]))
        probs, passages = [], []
        for a, b in zip(ends[:-1], ends[1:]):
            x, good = evidence(model, segments(scores[a:b]), int(b - a))
            probs.append(probability(model, x))
            passages.append([{"start": s, "stop": t, "score": v, "e": e} for s, t, v, e in good])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(probs), pa.array(passages, kind)], ["doc_id", "score", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (token places, score, E) of every text, without a shuffle."""
    return mapped(texts(docs), lambda it: _scan(it, model), f"doc_id long, score double, passages {SEGMENTS}")


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
