"""Operator 13, substring deduplication: words of 20-word windows that also start earlier, by suffix automata.

The text that can repeat is found first. Windows choose an anchor, the least 8-word gram in them by a hash, so equal
windows choose equal anchors; neighbouring windows with one anchor make a piece of 20 to 32 words.

1. Pieces (anchor, hash of the piece, document, place) are range-partitioned by splitters sampled from them and
   sorted. Of equal pieces all but the earliest repeat as a whole, which pre-aggregates groups of copies. An
   earliest piece whose anchor has other pieces as well is searched further; any other is new.
2. Searched pieces are the reference. They are dealt to shards by their anchor, each shard of a bounded size, and every shard
   becomes a suffix automaton whose states know where their string starts first. It is built in the task that has the shard's
   pieces and lives no longer: an automaton takes some forty bytes a word, so it is neither written nor sent.
3. Pieces stream, in packs, past the automaton of their shard: all of a pack advance by one word at a
   time and keep their matching statistics up to 20. A window repeats if the state it reaches starts earlier than it does.
4. An anchor with too many different pieces for a shard (the edge of a passage that a third of all documents share)
   is searched by longer anchors instead, of 14 words and then of 20, where a piece is one window and equal pieces are all there is.
   So no shard grows with a group, and nothing is compared in pairs.

Marks of a document are merged to maximal spans and cut out. Texts are not shuffled while marks fit a checked broadcast.
Words are told apart by 64-bit hashes. Defined results: a null text has no words; fewer than 20 words lose nothing;
"earlier" is by doc_id, then place; rows with the same doc_id are one document (each gives its own row, and what repeats is
removed from all); a row with a null doc_id has no place in that order: it is returned whole and hides nothing. Columns other than
doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import suffix
from tracewright.llm.common import columns, mapped, rows_bound, settle, small_batches, texts
from tracewright.llm.shingles import WordHashes, ngrams

#: Words of a window, and of the anchors of each turn.
WINDOW, ANCHORS = 20, (8, 14, 20)
#: Different pieces of an anchor and words of a shard, bytes of keys that are broadcast, words of a pack.
PIECES, SHARD, BROADCAST_BYTES, PACK = 1_000, 60_000, 32 << 20, 60_000
#: Bytes of text that are split into words at once.
STEP = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_PLACES = np.uint64((1 << 32) - 1)
#: Bytes that a key takes in a broadcast.
KEY_BYTES = 64
ENTRY = suffix.ENTRY + ", shape int"
#: A piece that is searched: where its first window starts, and the hashes of its words.
PIECE = "t1 long, doc long, place long, words binary"


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        stop = at + STEP
        if stop < len(text):
            cut = _SPACE.search(text, stop)
            stop = cut.start() if cut else len(text)
        yield text[at:stop].split()
        at = stop


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    out = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in stretches(text)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(hashes: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """first, last window of each piece, its anchor, the hash of all its words."""
    grams, whole = ngrams(hashes, gram), ngrams(hashes, WINDOW)
    n, span = len(whole), WINDOW - gram + 1
    least = (grams & ~_PLACES) | np.arange(len(grams), dtype=np.uint64)  # of equal grams the first
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = (np.minimum(least[:n], least[span - width : span - width + n]) & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    shape = (at[first] - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)
    return first, last, grams[at[first]], suffix._mix(suffix._mix(whole[first], whole[last]), shape)


def _entry_batch(found: list[tuple], splitters: suffix.Splitters) -> pa.RecordBatch:
    """Entries of (doc, t1, t2, place, windows after the first, windows of the piece searched before that come earlier)."""
    doc, t1, t2, place, n, skip = (np.concatenate(x) for x in zip(*found))
    out = suffix._batch(doc, t1, t2, place, splitters)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array((skip << 8 | n).astype(np.int32))], [*out.schema.names, "shape"])


def _of_texts(batches: Iterator[pa.RecordBatch], gram: int, splitters: suffix.Splitters) -> Iterator[pa.RecordBatch]:
    """Pieces of documents, as entries."""
    known = WordHashes.of_worker()
    for batch in small_batches(batches):
        found = []
        for doc, body in zip(*columns(batch)):
            hashes = word_hashes(body, known)
            if len(hashes) >= WINDOW:
                first, last, t1, t2 = pieces(hashes, gram)
                found.append((np.full(len(first), doc, np.int64), t1, t2, first, last - first, np.zeros(len(first), np.int64)))
        if found:
            yield _entry_batch(found, splitters)


def _of_pieces(batches: Iterator[pa.RecordBatch], gram: int, splitters: suffix.Splitters) -> Iterator[pa.RecordBatch]:
    """Pieces of pieces by longer anchors, as entries."""
    for batch in batches:
        found = []
        for doc, place, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "place", "words"))):
            first, last, t1, t2 = pieces(np.frombuffer(words, np.uint64), gram)
            found.append((np.full(len(first), doc, np.int64), t1, t2, first + place, last - first, first))
        if found:
            yield _entry_batch(found, splitters)


def _judged(batches: Iterator[pa.RecordBatch], splitters: suffix.Splitters) -> Iterator[pa.RecordBatch]:
    """A sorted bucket: words [a, b) of pieces that repeat or, with t1, of earliest pieces whose anchor has others; place: of the piece searched before that they lie in."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    bucket = int(t.column("bucket")[0].as_py())
    t1, t2, doc, place, shape = (t.column(c).to_numpy() for c in ("t1", "t2", "doc", "place", "shape"))
    del t, held
    t1, t2 = t1.view(np.uint64), t2.view(np.uint64)
    order = suffix.multikey_order([t1, t2, suffix._unsigned(doc), place.astype(np.uint64)])
    t1, t2, doc, place, shape = (x[order] for x in (t1, t2, doc, place, shape))
    new1 = np.r_[True, t1[1:] != t1[:-1]]
    new2 = new1 | np.r_[True, t2[1:] != t2[:-1]]
    head = np.flatnonzero(new2)[np.cumsum(new2) - 1]
    repeat = (doc != doc[head]) | (place != place[head])
    group = np.cumsum(new1) - 1
    mixed = np.bincount(group, new2)[group] > 1
    if bucket:
        edge = splitters[bucket - 1]
        repeat |= (t1 == edge[0]) & (t2 == edge[1])
        mixed |= t1 == edge[0]
    if bucket < len(splitters):
        mixed |= t1 == splitters[bucket, 0]
    keep = repeat | mixed
    a, shape = place[keep], shape[keep].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(t1[keep].view(np.int64), mask=repeat[keep]), pa.array(doc[keep]), pa.array(a), pa.array(a + (shape & 255) + WINDOW), pa.array(a - (shape >> 8))], ["t1", "doc", "a", "b", "place"])


def _judge(rows: DataFrame, make, gram: int, entries: int, sample: DataFrame) -> DataFrame:
    """Marks (t1 null) and searched pieces of rows, through range-partitioned and sorted entries."""
    none = np.zeros((0, 4), np.uint64)
    splitters = suffix._splitters(mapped(sample, lambda it: make(it, gram, none), ENTRY), max(2, -(-entries // suffix.BUCKET)))
    dealt = suffix._partitioned(mapped(rows, lambda it: make(it, gram, splitters), ENTRY), splitters)
    return settle(dealt.mapInArrow(lambda it: _judged(it, splitters), "t1 long, doc long, a long, b long, place long"), "automata-marks")


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their searched pieces -> the pieces with the hashes of their words."""
    known = WordHashes.of_worker()
    for batch in small_batches(batches):
        out = []
        for doc, body, asked in zip(*columns(batch), batch.column("asked").to_pylist()):
            hashes = word_hashes(body, known)
            out += [(s["t1"], doc, s["a"], hashes[s["a"] : s["b"]].tobytes()) for s in asked if s["b"] <= len(hashes)]
        if out:
            t1, doc, place, words = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(words, pa.binary())], ["t1", "doc", "place", "words"])


class Automaton:
    """The suffix automaton of pieces: length and link of each state, transitions as sorted keys of state and letter."""

    def __init__(self, length: np.ndarray, link: np.ndarray, letters: np.ndarray, keys: np.ndarray, to: np.ndarray) -> None:
        self.length, self.link, self.letters, self.keys, self.to = length, link, letters, keys, to

    @classmethod
    def of(cls, words: list[np.ndarray]) -> tuple[Automaton, np.ndarray]:
        """The automaton and, for each state, the index (over the words of all pieces) of the last word where its string occurs first."""
        letters, codes = np.unique(np.concatenate(words), return_inverse=True)
        length, link, ends, goes = [0], [-1], [-1], [{}]
        at = 0
        for piece in np.split(codes, np.cumsum([len(w) for w in words])[:-1]):
            last = 0
            for c in piece.tolist():
                last = cls._extend(length, link, ends, goes, last, c, at)
                at += 1
        keys = np.array([s << 32 | c for s, d in enumerate(goes) for c in d], np.int64)
        to = np.array([t for d in goes for t in d.values()], np.int32)
        order = np.argsort(keys)
        return cls(np.array(length, np.int32), np.array(link, np.int32), letters, keys[order], to[order]), np.array(ends, np.int64).clip(0)

    @staticmethod
    def _extend(length: list, link: list, ends: list, goes: list, last: int, c: int, at: int) -> int:
        """The state after ``last`` by c, which is made, or split off another, where there is none."""
        to = goes[last].get(c)
        if to is not None and length[to] == length[last] + 1:
            return to
        if to is None:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            ends.append(at)
            goes.append({})
            p = last
            while p >= 0 and c not in goes[p]:
                goes[p][c] = new
                p = link[p]
            if p < 0:
                return new
            to = goes[p][c]
            if length[to] == length[p] + 1:
                link[new] = to
                return new
        else:
            new, p = None, last
        half = len(length)
        length.append(length[p] + 1)
        link.append(link[to])
        ends.append(ends[to])
        goes.append(dict(goes[to]))
        link[to] = half
        if new is not None:
            link[new] = half
        while p >= 0 and goes[p].get(c) == to:
            goes[p][c] = half
            p = link[p]
        return half if new is None else new

    def step(self, state: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and matched lengths after one more word each (code -1: a word that no piece has)."""
        state, length = np.where(code < 0, 0, state), np.where(code < 0, 0, length)
        todo = np.flatnonzero(code >= 0)
        while len(todo):
            key = state[todo].astype(np.int64) << 32 | code[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.to[at[hit]]
            length[todo[hit]] += 1
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state[todo] = self.link[state[todo]]
            length[todo] = self.length[state[todo]]
        return state, length

    def windows(self, state: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States cut down to the last WINDOW words matched."""
        todo = np.flatnonzero(length >= WINDOW)
        length[todo] = WINDOW
        while len(todo):
            up = self.link[state[todo]]
            todo, up = todo[self.length[up] >= WINDOW], up[self.length[up] >= WINDOW]
            state[todo] = up
        return state, length


def matched(automaton: Automaton, first: tuple[np.ndarray, np.ndarray], docs: np.ndarray, places: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places (index of a piece, window in it) of windows that start earlier too, by matching statistics of all pieces at once."""
    at = np.searchsorted(automaton.letters, words).clip(0, len(automaton.letters) - 1)
    codes = np.where(automaton.letters[at] == words, at, -1)
    start = np.cumsum(sizes) - sizes
    state, length, found = np.zeros(len(docs), np.int32), np.zeros(len(docs), np.int32), []
    for k in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > k)
        s, n = automaton.windows(*automaton.step(state[on], length[on], codes[start[on] + k]))
        state[on], length[on] = s, n
        full = n >= WINDOW
        on, s = on[full], s[full]
        doc, place = first[0][s], first[1][s] - (WINDOW - 1)
        earlier = (doc < docs[on]) | ((doc == docs[on]) & (place < places[on] + k - (WINDOW - 1)))
        found.append(np.stack([on[earlier], np.full(earlier.sum(), k - (WINDOW - 1))]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one shard of a partition: the automaton of its pieces, put in by place, and the pieces past it in packs of about PACK words -> marks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = pa.Table.from_batches(held).sort_by([("doc", "ascending"), ("place", "ascending")])
    docs, places = (shard.column(c).to_numpy() for c in ("doc", "place"))
    words = [np.frombuffer(w, np.uint64) for w in shard.column("words").to_pylist()]
    del shard, held
    automaton, ends = Automaton.of(words)
    sizes = np.array([len(w) for w in words])
    start = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(words)), sizes)
    first = docs[piece][ends], (places[piece] + np.arange(len(piece)) - start[piece])[ends]
    cuts = np.flatnonzero(np.diff(start // PACK)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
        at, window = matched(automaton, first, docs[a:b], places[a:b], sizes[a:b], np.concatenate(words[a:b]))
        begin = places[a:b][at] + window
        yield pa.RecordBatch.from_arrays([pa.array(docs[a:b][at]), pa.array(begin), pa.array(begin + WINDOW)], ["doc", "a", "b"])


def searched(found: DataFrame) -> DataFrame:
    """doc, a, b of the windows of pieces (t1, doc, place, words) that start earlier in another piece with their anchor: a task a reference shard."""
    n = found.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(1, -(-int(n) // SHARD))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("t1"), F.lit(shards)).cast("int")).select("shard", "doc", "place", "words")
    return mapped(dealt.repartitionById(shards, F.col("shard")), _searched, "doc long, a long, b long")


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if rows_bound(keys, BROADCAST_BYTES // KEY_BYTES) else keys


def repeats(docs: DataFrame) -> DataFrame:
    """doc, a, b: the maximal runs of words [a, b) of each document that are to be removed."""
    body = texts(docs).where("doc_id is not null")
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, size // 40)
    judged = _judge(body, _of_texts, ANCHORS[0], n, suffix._sampled_rows(body, suffix.SAMPLE / n))
    marks = judged.where("t1 is null").select("doc", "a", "b")
    asked = judged.where("t1 is not null").groupBy("doc").agg(F.collect_list(F.struct("t1", "a", "b")).alias("asked"))
    rows = suffix._with_marks(body, settle(asked, "automata-asked"), "asked", 24, "inner")
    found = settle(mapped(rows, _with_words, PIECE), "automata-pieces")
    for gram in ANCHORS[1:]:
        crowded = settle(found.groupBy("t1").count().where(F.col("count") > PIECES).select("t1"), "automata-crowded")
        crowd = settle(found.join(_small(crowded), "t1", "left_semi"), "automata-crowd")
        n = crowd.count()
        if not n:
            break
        marks = marks.union(searched(found.join(_small(crowded), "t1", "left_anti")))
        share = int(1_000_000 * min(1.0, suffix.SAMPLE / (4 * n))) + 1
        judged = _judge(crowd, _of_pieces, gram, 4 * n, crowd.where(F.pmod(F.xxhash64("doc", "place"), F.lit(1_000_000)) < share))
        marks = marks.union(judged.where("t1 is null").select("doc", "a", "b"))
        inner = judged.where("t1 is not null").join(crowd.drop("t1"), ["doc", "place"])
        found = settle(inner.select("t1", "doc", F.col("a").alias("place"), F.expr("substring(words, cast((a - place) * 8 + 1 as int), cast((b - a) * 8 as int))").alias("words")), "automata-pieces")
    marks = marks.union(searched(found))
    return marks.repartition("doc").sortWithinPartitions("doc", "a").mapInArrow(suffix._merged, "doc long, a long, b long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in small_batches(batches):
        out = []
        for doc, body, spans in zip(*columns(batch), batch.column("spans").to_pylist()):
            spans = sorted((s["a"], s["b"]) for s in spans or ())
            base, i, kept = 0, 0, []
            for words in stretches(body):
                at = 0
                while i < len(spans) and spans[i][0] < base + len(words):
                    a, b = spans[i][0] - base, spans[i][1] - base
                    kept += words[at : max(a, at)]
                    at = min(b, len(words))
                    if b > len(words):
                        break
                    i += 1
                kept += words[at:]
                base += len(words)
            text = b" ".join(kept)
            out.append((doc, base, base - len(kept), [{"a": a, "b": b} for a, b in spans], hashlib.sha256(text).hexdigest(), text.decode()))
        doc, n, gone, spans, sha, text = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(sha), pa.array(text)], ["doc_id", "n_words", "n_removed", "spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of a, b), kept_sha256 and kept (the remaining words) of every row."""
    marks = settle(repeats(docs).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "automata-spans")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept string"
    return mapped(suffix._with_marks(texts(docs), marks, "spans", 16, "left"), _cut, schema)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns."""
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as strings; a word goes if one of the windows that cover it starts earlier too.
ORACLE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
v AS (SELECT *, CASE WHEN count(*) OVER x = {WINDOW} THEN string_agg(word, ' ') OVER x END AS win FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, pos, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM v),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
