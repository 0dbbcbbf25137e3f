"""Operator 2, language identification by a linear-chain conditional random field over words.

Words are runs of letters; a longer run than ``WORD`` letters, as in scripts without spaces, is several words.
A word's features are itself, its affixes, its character n-grams and how strongly a lexicon learnt from the
corpus ties it to each language, all hashed into one weight table; transitions between the languages of
neighbouring words are learnt with them. Forward-backward labels every word, so a text that switches between
languages keeps both; a text's language is the one with the largest sum of word posteriors, its score the
share of that sum.

Training labels: of each sampled document the words get its language, but for stretches that the lexicon gives
clearly to another one. At most ``most_docs`` documents that are not held out are used, the first by a hash of
doc_id. Scores depend on the text alone. Defined results: a text that is null or has no letters is ``und`` with
score 0. A null doc_id is returned as such and is not held out. Without any labelled document all texts are
``und``. Repeated rows each get their own row. Columns other than doc_id, text and (for learning) lang are
never read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import columns, held_out, mapped, of_worker, settle, small_batches, texts

BITS = 16
#: Words that a segment of the two-level forward-backward holds.
SEGMENT = 64
#: Words of chunks whose emissions a worker remembers.
CACHE = 600_000
#: Letters of the longest word.
WORD = 40


def letters(chunk: bytes) -> list[str]:
    """The words of a white-space chunk in lower case: its runs of letters, cut after every WORD of them. Marks and joiners within a word are left out."""
    s = chunk.decode("utf-8", "replace").lower()
    if s.isalpha():
        return [s] if len(s) <= WORD else [s[k : k + WORD] for k in range(0, len(s), WORD)]
    runs = "".join(c if c.isalpha() else "" if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") else " " for c in s).split(" ")
    return [r[k : k + WORD] for r in runs for k in range(0, len(r), WORD)]


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words as (ids, places in words), sorted by place: the word, its affixes of 2 to 4 bytes, its byte 2-grams and 3-grams, its ties by the lexicon.

    An n-gram at the beginning or end of a word is its affix under another tag, so all are read off one array of
    bytes, each word between < and >.
    """
    spelled = [f"<{w}>".encode() for w in words]
    code = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    owner, last = np.repeat(np.arange(len(words)), size), np.cumsum(size)
    first = last - size
    whole = np.fromiter(map(zlib.crc32, spelled), np.uint64, len(spelled))
    ids, places = [_hashed(whole, 1)], [np.arange(len(words))]
    gram = code
    for k in (2, 3, 4):
        gram = gram[:-1] * np.uint64(256) + code[k - 1 :]
        if k < 4:
            inside = owner[: len(gram)] == owner[k - 1 :]
            ids.append(_hashed(gram[inside], k))
            places.append(owner[: len(gram)][inside])
        long = np.flatnonzero(size >= k)
        ids += [_hashed(gram[first[long]], 10 + k), _hashed(gram[last[long] - k], 20 + k)]
        places += [long, long]
    known = [(i, t) for i, w in enumerate(words) if (t := lexicon.get(w))]
    if known:
        ties = np.array([t for _, t in known])
        ids.append(_hashed((ties + 8 + 32 * np.arange(ties.shape[1])).astype(np.uint64).ravel(), 30))
        places.append(np.repeat([i for i, _ in known], ties.shape[1]))
    ids, places = np.concatenate(ids), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return ids[order], places[order]


def _hashed(code: np.ndarray, tag: int) -> np.ndarray:
    h = (code + np.uint64(tag << 40)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  #: 2^BITS x languages
    lexicon: dict[str, tuple[int, ...]]  #: word -> strength of its tie to each language, in steps
    transitions: np.ndarray
    key: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of words, by language: the sums of their features' weights."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        ids, places = features(words, self.lexicon)
        starts = np.searchsorted(places, np.arange(len(words)))
        return np.add.reduceat(self.weights[ids], starts, axis=0)


def posteriors(e: np.ndarray, a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word posteriors of many texts at once. e: exp(emissions) of all words; a: exp(transitions); ends: where each text ends.

    Exact forward-backward in two levels: texts are cut into segments, each segment's product of transition
    and emission matrices is formed for all segments in step, messages pass from segment to segment by those
    products, and then through all segments in step.
    """
    n_langs = e.shape[1]
    starts = np.r_[0, ends[:-1]]
    per_text = -(-(ends - starts) // SEGMENT)
    text_of = np.repeat(np.arange(len(ends)), per_text)
    first = np.cumsum(per_text) - per_text
    nth = np.arange(len(text_of)) - first[text_of]
    seg_start = starts[text_of] + nth * SEGMENT
    seg_len = np.minimum(SEGMENT, ends[text_of] - seg_start)
    n = len(text_of)
    out = np.zeros_like(e)
    if not n:
        return out
    product = np.tile(np.eye(n_langs, dtype=np.float32), (n, 1, 1))
    steps = [np.flatnonzero(seg_len > t) for t in range(int(seg_len.max()))]
    for t, on in enumerate(steps):
        full = len(on) == n
        p = product if full else product[on]
        p = (p.reshape(-1, n_langs) @ a).reshape(-1, n_langs, n_langs) * e[seg_start[on] + t][:, None, :]
        p /= p.max(axis=(1, 2), keepdims=True)
        if full:
            product = p
        else:
            product[on] = p
    forward, backward = np.ones((n, n_langs), np.float32), np.ones((n, n_langs), np.float32)
    most = int(per_text.max())
    for k in range(1, most):  # what enters segment k of each text
        now = first[per_text > k] + k
        f = np.einsum("ni,nij->nj", forward[now - 1], product[now - 1])
        forward[now] = f / f.max(axis=1, keepdims=True)
    for k in range(most - 2, -1, -1):
        now = first[per_text > k + 1] + k
        b = np.einsum("nij,nj->ni", product[now + 1], backward[now + 1])
        backward[now] = b / b.max(axis=1, keepdims=True)
    for t, on in enumerate(steps):
        f = (forward[on] @ a) * e[seg_start[on] + t]
        f /= f.max(axis=1, keepdims=True)
        forward[on] = f
        out[seg_start[on] + t] = f
    for t in range(len(steps) - 1, -1, -1):
        on = steps[t]
        at, b = seg_start[on] + t, backward[on]
        out[at] *= b
        b = (b * e[at]) @ a.T
        backward[on] = b / b.max(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def learn_lexicon(words: np.ndarray, docs_lang: np.ndarray, n_words: int, n_langs: int) -> np.ndarray:
    """log p(language | word) against the mean language, smoothed."""
    counts = np.zeros((n_words, n_langs))
    np.add.at(counts, (words, docs_lang), 1)
    rates = (counts + 0.5) / (counts.sum(0) + 0.5 * n_words)
    logs = np.log(rates)
    return np.clip(logs - logs.mean(1, keepdims=True), -3, 3)


def train(bodies: list[bytes], langs: list[str], *, epochs: int = 4, step: float = 0.3, batch: int = 1024, ridge: float = 1e-4, seed: int = 7) -> Model | None:
    """A field from documents and their languages."""
    names = sorted(set(langs))
    if not names:
        return None
    n_langs, rng = len(names), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for b in bodies:
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for c in b.split() for w in letters(c)], np.int64))
    words, owner = np.concatenate([*docs, np.zeros(0, np.int64)]), np.repeat([names.index(x) for x in langs], [len(d) for d in docs])
    ties = learn_lexicon(words, owner, len(vocabulary), n_langs)
    times = np.bincount(words, minlength=len(vocabulary))
    lexicon = {w: tuple(int(x) for x in np.rint(ties[i])) for w, i in vocabulary.items() if times[i] >= 5}
    model = Model(names, np.zeros((1 << BITS, n_langs), np.float32), lexicon, np.eye(n_langs, dtype=np.float32))
    if n_langs == 1:
        return model
    # labels: the document's language, but for stretches that the lexicon gives to another by a wide margin
    labels, sequences, begin = owner.copy(), [], 0
    for d in docs:
        own = ties[d]
        total = np.cumsum(np.r_[np.zeros((1, n_langs)), own], axis=0)
        low, high = np.maximum(np.arange(len(d)) - 7, 0), np.minimum(np.arange(len(d)) + 8, len(d))
        near = (total[high] - total[low]) / np.maximum(high - low, 1)[:, None]
        if len(d):
            best = near.argmax(1)
            held = near[np.arange(len(d)), owner[begin : begin + len(d)]]
            switch = near.max(1) > held + 0.8
            labels[begin : begin + len(d)][switch] = best[switch]
        sequences += [(begin + k, min(32, len(d) - k)) for k in range(0, len(d), 32)]
        begin += len(d)
    flat, places = features(list(vocabulary), lexicon)
    sizes = np.bincount(places, minlength=len(vocabulary))
    offset = np.r_[0, np.cumsum(sizes)]
    sequences = np.array(sequences)
    g_w, g_t = np.full((1 << BITS, n_langs), 1e-8), np.full((n_langs, n_langs), 1e-8)
    weights, trans = np.zeros((1 << BITS, n_langs)), np.eye(n_langs)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
            s, length = sequences[part, 0], sequences[part, 1]
            used = [np.flatnonzero(length > t) for t in range(int(length.max()))]
            at = np.concatenate([np.arange(x, x + k) for x, k in zip(s, length)])
            kinds, inverse = np.unique(words[at], return_inverse=True)
            pick = np.concatenate([np.arange(offset[k], offset[k + 1]) for k in kinds])
            local = np.r_[0, np.cumsum(sizes[kinds])[:-1]]
            e_kind = np.add.reduceat(weights[flat[pick]], local, axis=0)
            where = np.zeros(len(s), np.int64)
            where[1:] = np.cumsum(length)[:-1]
            e = np.exp(e_kind - e_kind.max(1, keepdims=True))[inverse]
            a = np.exp(trans - trans.max())
            fw, f = np.zeros_like(e), np.ones((len(s), n_langs))
            for t, on in enumerate(used):
                x = (f[on] @ a) * e[where[on] + t]
                f[on] = fw[where[on] + t] = x / x.sum(1, keepdims=True)
            gold = labels[at]
            post, b, d_t = np.zeros_like(e), np.ones((len(s), n_langs)), np.zeros((n_langs, n_langs))
            for t in range(len(used) - 1, -1, -1):
                on = used[t]
                here = where[on] + t
                x = fw[here] * b[on]
                post[here] = x / x.sum(1, keepdims=True)
                be = b[on] * e[here]
                if t:
                    pair = fw[here - 1][:, :, None] * a[None] * be[:, None, :]
                    d_t += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                    np.add.at(d_t, (gold[here - 1], gold[here]), -1)
                nb = be @ a.T
                b[on] = nb / nb.sum(1, keepdims=True)
            post[np.arange(len(at)), gold] -= 1
            d_kind = np.stack([np.bincount(inverse, post[:, k], len(kinds)) for k in range(n_langs)], 1) / len(s)
            d_flat = np.repeat(d_kind, sizes[kinds], axis=0)
            rows = flat[pick]
            d_w = np.stack([np.bincount(rows, d_flat[:, k], 1 << BITS) for k in range(n_langs)], 1) + ridge * weights
            g_w += d_w * d_w
            weights -= step * d_w / np.sqrt(g_w)
            d_t = d_t / len(s) + ridge * trans
            g_t += d_t * d_t
            trans -= step * d_t / np.sqrt(g_t)
    model.weights, model.transitions = weights.astype(np.float32), trans.astype(np.float32)
    model.key = f"{zlib.crc32(model.weights.tobytes())}-{zlib.crc32(model.transitions.tobytes())}"
    return model


class Emissions:
    """exp(emissions) of the words of white-space chunks in a growing table, those of a chunk one after another; row 0 stands for chunks without letters."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.used = model, {}, 1
        self.table, self.sizes = np.ones((1 << 16, len(model.langs)), np.float32), np.zeros(1 << 16, np.int64)

    @classmethod
    def of_worker(cls, model: Model) -> Emissions:
        return of_worker(f"emissions {model.key}", lambda: cls(model))

    def ids(self, bodies: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of bodies, and how many words each body has."""
        if self.used > CACHE:
            self.rows, self.used = {}, 1
        rows = self.rows
        new = list(set().union(*bodies).difference(rows))
        spelled = [letters(c) for c in new]
        size = np.fromiter(map(len, spelled), np.int64, len(new))
        kinds = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(spelled)))}
        stop = self.used + int(size.sum())
        if stop > len(self.table):
            grown, sizes = np.ones((2 * stop, self.table.shape[1]), np.float32), np.zeros(2 * stop, np.int64)
            grown[: self.used], sizes[: self.used] = self.table[: self.used], self.sizes[: self.used]
            self.table, self.sizes = grown, sizes
        place = np.where(size > 0, self.used + np.cumsum(size) - size, 0)
        if kinds:
            names = list(kinds)
            e = np.concatenate([self.model.emissions(names[k : k + (1 << 16)]) for k in range(0, len(names), 1 << 16)])
            e = np.maximum(np.exp(e - e.max(1, keepdims=True)), 1e-12)
            self.table[self.used : stop] = e[np.fromiter(map(kinds.__getitem__, chain.from_iterable(spelled)), np.int64, stop - self.used)]
            self.sizes[place[size > 0]] = size[size > 0]
        rows.update(zip(new, place.tolist()))
        self.used = stop
        n = np.array([0, *map(len, bodies)]).cumsum()
        at = np.fromiter(map(rows.__getitem__, chain.from_iterable(bodies)), np.int64, int(n[-1]))
        times = self.sizes[at]
        ends = np.r_[0, np.cumsum(times)]
        return np.repeat(at - ends[:-1], times) + np.arange(ends[-1]), np.diff(ends[n])


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    held = Emissions.of_worker(model)
    a = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    names = np.array(model.langs, object)
    for batch in small_batches(batches, 2 << 20):
        ids, bodies = columns(batch)
        rows, counts = held.ids([b.split() for b in bodies])
        ends = np.cumsum(counts)
        post = posteriors(held.table[rows], a, ends)
        sums = np.diff(np.r_[np.zeros((1, len(names))), np.cumsum(post, axis=0, dtype=np.float64)][np.r_[0, ends]], axis=0)
        best = sums.argmax(1)
        some = counts > 0
        other = np.zeros(len(post) + 1, np.int64)
        if len(post):
            other[1:] = np.cumsum(post.argmax(1) != np.repeat(best, counts))
        switched = other[ends] - other[np.r_[0, ends[:-1]]]
        score = np.where(some, sums[np.arange(len(best)), best] / np.maximum(counts, 1), 0.0)
        lang = np.where(some, names[best], "und")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(counts.astype(np.int64)), pa.array(switched.astype(np.int64))], ["doc_id", "lang_pred", "score", "n_words", "n_switched"])


def fit(docs: DataFrame, *, most_docs: int = 3_000, most_bytes: int = 65_536) -> Model | None:
    """A model from about most_docs labelled documents at most that are not held out, an even share of each language (all of a rare one), first by a hash of doc_id.

    Texts over most_bytes are not learnt from: with most_docs that bounds what the driver gets.
    """
    able = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out()).where(F.octet_length("text") <= most_bytes)
    labelled = settle(able.groupBy("doc_id").agg(F.min("lang").alias("lang")), "lang-labels")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    each, left = even_share(counts, most_docs), F.lit(False)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    for lang, n in counts.items():
        left = left | ((F.col("lang") == lang) & (h < int((1 << 40) * min(1.0, each / n))))
    chosen = F.broadcast(labelled.where(left))  # bounded by most_docs
    rows = able.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    sample = rows.orderBy("doc_id").select("text", "lang").toPandas()
    return train([t.encode() for t in sample["text"]], list(sample["lang"]))


def even_share(counts: dict[str, int], most: int) -> float:
    """So many of each language make ``most`` in all, where the rare ones have fewer."""
    rest = sorted(counts.values())
    while rest and rest[0] <= most / len(rest):
        most -= rest.pop(0)
    return most / len(rest) if rest else float(max(counts.values(), default=0))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words (runs of letters) and n_switched (words labelled with another language)."""
    if model is None:
        return texts(docs).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switched"))
    return mapped(texts(docs), lambda it: _predict(it, model), "doc_id long, lang_pred string, score double, n_words long, n_switched long")


def digest(predicted: DataFrame) -> DataFrame:
    """The contract's columns."""
    return predicted.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switched")
