"""Operator 8, suffix-array deduplication: bytes of 100-byte strings that also start earlier.

A full suffix array has an entry for each byte. Here suffixes are sampled so that equal strings sample alike:
each 100-byte string is stood for by the suffix that begins at its least 32-byte gram (by a hash), about one
suffix for 31 bytes. A suffix's first token is that gram, its second all the bytes of the strings it stands
for. Three rounds refine what two suffixes share:

1. suffixes by (gram, context): strings of a context that came before are repeats;
2. of contexts that are new but whose gram has others, runs of eight strings by the 93 bytes they all hold;
3. of runs whose core occurs in others, each string by its 100 bytes.

In each round entries (first token, second token, document, place) are range-partitioned by splitters sampled
from them, buckets sort locally by multikey quicksort (three-way on one column at a time, only ties go on to
the next), and a string repeats if its group has an earlier entry. Document and place are part of the order, so
a string that is everywhere is spread over buckets; a splitter is itself an entry and belongs to the bucket
below, so a bucket compares with what lies before it by its lower splitter alone. Texts are not shuffled while
marks fit a checked broadcast.

Tokens are 64-bit hashes, and a repeat needs both tokens of a suffix to be equal. Defined results: a null text
is empty; a text under 100 bytes loses nothing. "Earlier" is by doc_id, then place; rows with the same doc_id
are one document (each gives its own row, and what repeats is removed from all). A row with a null doc_id has
no place in that order: it is returned whole and hides nothing. Columns other than doc_id and text are never
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import columns, mapped, settle, small_batches, texts

#: Bytes of a removable string, of the gram that a sampled suffix begins with, and strings in a run of round 2.
LENGTH, GRAM, RUN = 100, 32, 8
CORE = LENGTH - RUN + 1
#: Long texts are sampled in pieces that overlap by LENGTH - 1 bytes; places within a piece fit PLACE_BITS.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 2 * LENGTH
#: Entries of a bucket, entries that splitters are taken from, rows of a sort that are not parted any more, and bytes of marks that are broadcast.
BUCKET, SAMPLE, SMALL, BROADCAST_BYTES = 400_000, 60_000, 8_192, 32 << 20
ENTRY = "bucket int, t1 long, t2 long, doc long, place long"
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _A
    h += y
    h ^= h >> _S
    h *= _B
    return h


def _doubled(h: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of twice as many bytes for each size, along the last axis."""
    for k in sizes:
        h = _mix(h[..., :-k], h[..., k:])
    return h


def sampled(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a piece: place, first and last string that each stands for, gram, context."""
    gram = _doubled(_mix(text.astype(np.uint64), np.uint64(1)), (1, 2, 4, 8, 16))
    half = _doubled(gram, (32,))
    n = len(text) - LENGTH + 1
    whole = _mix(half[:n], half[LENGTH - 64 :])
    least = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = (np.minimum(least[:n], least[span - width : span - width + n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    place = at[first]
    shape = (place - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)
    return place, first, last, gram[place], _mix(_mix(whole[first], whole[last]), shape)


def pack_place(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place.astype(np.int64) << 14) | ((place - first) << 7) | (last - first)


def unpack_place(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = packed >> 14
    first = place - ((packed >> 7) & 127)
    return place, first, first + (packed & 127)


Splitters = np.ndarray  #: rows of (t1, t2, doc, place), as unsigned numbers in order


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Signed numbers, so that unsigned order is theirs."""
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def bucket_of(cols: list[np.ndarray], splitters: Splitters) -> np.ndarray:
    """How many splitters lie before each entry."""
    low = np.searchsorted(splitters[:, 0], cols[0], "left")
    high = np.searchsorted(splitters[:, 0], cols[0], "right")
    for i in np.flatnonzero(high > low):  # entries of a group that is cut
        a, b, own = int(low[i]), int(high[i]), [int(c[i]) for c in cols]
        while a < b:
            mid = (a + b) // 2
            if splitters[mid].tolist() < own:
                a = mid + 1
            else:
                b = mid
        low[i] = a
    return low


def multikey_order(cols: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns, by multikey quicksort: rows are parted in three by a pivot of one column, and only those equal to it go on to the next column. Parts of SMALL rows or fewer are sorted by all columns that are left."""
    out = np.arange(len(cols[0]))
    todo = [(0, len(out), 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2 or k == len(cols):
            continue
        rows = out[a:b]
        if b - a <= SMALL:
            out[a:b] = rows[np.lexsort([c[rows] for c in reversed(cols[k:])])]
            continue
        key = cols[k][rows]
        pivot = np.sort(key[:: (b - a) // 32])[16]
        low, high = key < pivot, key > pivot
        i, j = a + int(low.sum()), b - int(high.sum())
        out[a:b] = np.concatenate([rows[low], rows[~(low | high)], rows[high]])
        todo += [(a, i, k), (i, j, k + 1), (j, b, k)]
    return out


def _batch(doc: np.ndarray, t1: np.ndarray, t2: np.ndarray, place: np.ndarray, splitters: Splitters) -> pa.RecordBatch:
    bucket = bucket_of([t1, t2, _unsigned(doc), place.astype(np.uint64)], splitters)
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(doc), pa.array(place)], ["bucket", "t1", "t2", "doc", "place"])


def _suffixes(batches: Iterator[pa.RecordBatch], splitters: Splitters) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2 << 20):
        out = []
        for doc, body in zip(*columns(batch)):
            text = np.frombuffer(body, np.uint8)
            for base in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
                place, first, last, gram, context = sampled(text[base : base + PIECE + LENGTH - 1])
                out.append((np.full(len(place), doc, np.int64), gram, context, pack_place(place + base, first + base, last + base)))
        if out:
            yield _batch(*(np.concatenate(x) for x in zip(*out)), splitters)


def _cores(batches: Iterator[pa.RecordBatch], splitters: Splitters) -> Iterator[pa.RecordBatch]:
    """Round 2: runs of asked suffixes. t1: the core; t2: the seven bytes before it; place: core's place, strings, and the seven bytes after are kept apart in t3."""
    for batch in small_batches(batches, 2 << 20):
        docs, cores, before, after, places, valid = [], [], [], [], [], []
        for doc, body, asked in zip(*columns(batch), batch.column("asked").to_pylist()):
            text = np.frombuffer(b"\0" * RUN + body + b"\0" * RUN, np.uint8)
            place, first, last = unpack_place(np.sort(np.array(asked, np.int64)))
            low, high = (place - last) // RUN, (place - first) // RUN
            n = high - low + 1
            run = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, first, last = (np.repeat(x, n) for x in (place, first, last))
            core = place - RUN * run  # strings core - 7 .. core
            a, b = np.maximum(core - RUN + 1, first), np.minimum(core, last)
            for s in range(0, len(core), 20_000):
                c = core[s : s + 20_000]
                bytes_ = text[(c + 1)[:, None] + np.arange(CORE + 2 * (RUN - 1))]  # 7 before, the core, 7 after
                half = _doubled(_mix(bytes_[:, RUN - 1 : RUN - 1 + CORE].astype(np.uint64), np.uint64(1)), (1, 2, 4, 8, 16, 32))
                cores.append(_mix(half[:, 0], half[:, CORE - 64]))
                for out, side in ((before, bytes_[:, : RUN - 1]), (after, bytes_[:, -(RUN - 1) :])):
                    wide = np.zeros((len(c), 8), np.uint8)
                    wide[:, :7] = side
                    out.append(wide.view("<u8").ravel().astype(np.uint64))
            docs.append(np.full(len(core), doc, np.int64))
            places.append(core)
            valid.append(((core - b) << 3) | (b - a))
        if docs:
            doc, t1, t2, t3, core, v = (np.concatenate(x) for x in (docs, cores, before, after, places, valid))
            # after the core: 7 bytes; the strings take 6 bits of the eighth
            extra = (t3 | (v.astype(np.uint64) << np.uint64(56))).view(np.int64)
            out = _batch(doc, t1, t2, core, splitters)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(extra)], [*out.schema.names, "extra"])


def _windows(batches: Iterator[pa.RecordBatch], splitters: Splitters) -> Iterator[pa.RecordBatch]:
    """Buckets of round 2: strings of the runs whose core has others, as entries of round 3 (whose buckets are not dealt yet)."""
    for bucket, (t1, t2, doc, place, extra) in _buckets(batches, extra=True):
        if not len(t1):
            continue
        order = multikey_order([t1, _unsigned(doc), place.astype(np.uint64)])
        t1, t2, doc, place, extra = (x[order] for x in (t1, t2, doc, place, extra))
        new = np.r_[True, t1[1:] != t1[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        for edge in (bucket - 1, bucket):
            if 0 <= edge < len(splitters):
                several |= t1 == splitters[edge, 0]
        t1, t2, doc, place, extra = (x[several] for x in (t1, t2, doc, place, extra.view(np.uint64)))
        v = (extra >> np.uint64(56)).astype(np.int64)
        near, n = v >> 3, v & 7
        for k in range(RUN):  # the string that begins k bytes before the core
            on = (near <= k) & (k <= near + n)
            if on.any():
                lead = t2[on] >> np.uint64(8 * (7 - k)) if k else np.zeros(on.sum(), np.uint64)
                tail = extra[on] & np.uint64((1 << (8 * (7 - k))) - 1)
                h = _mix(_mix(t1[on], lead ^ np.uint64(k << 60)), tail)
                at = place[on] - k
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((_mix(h, lead) ^ tail).view(np.int64)), pa.array(doc[on]), pa.array(at)], ["t1", "t2", "doc", "place"])


def _dealt(batches: Iterator[pa.RecordBatch], splitters: Splitters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("doc", "t1", "t2", "place")]
        yield _batch(cols[0], cols[1].view(np.uint64), cols[2].view(np.uint64), cols[3], splitters)


def _buckets(batches: Iterator[pa.RecordBatch], extra: bool = False) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The one bucket of a partition."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        col = lambda c: t.column(c).to_numpy()
        out = (col("t1").view(np.uint64), col("t2").view(np.uint64), col("doc"), col("place"))
        yield int(t.column("bucket")[0].as_py()), (*out, col("extra")) if extra else out


def _compared(batches: Iterator[pa.RecordBatch], splitters: Splitters, strings: bool) -> Iterator[pa.RecordBatch]:
    """Sorted buckets of rounds 1 and 3: (doc, a, b, asked) with bytes [a, b) to remove or, with b null, a suffix for round 2."""
    for bucket, (t1, t2, doc, place) in _buckets(batches):
        order = multikey_order([t1, t2, _unsigned(doc), place.astype(np.uint64)])
        t1, t2, doc, place = t1[order], t2[order], doc[order], place[order]
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
        if strings:
            a, b, ask = place[repeat], place[repeat] + LENGTH, np.zeros(0, np.int64)
            ask_doc = doc[:0]
        else:
            _, first, last = unpack_place(place[repeat])
            a, b = first, last + LENGTH
            asks = ~repeat & mixed
            ask, ask_doc = place[asks], doc[asks]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[doc[repeat], ask_doc]), pa.array(np.r_[a, ask]), pa.array(np.r_[b, np.full(len(ask), -1)])], ["doc", "a", "b"])


def _splitters(sample: DataFrame, buckets: int) -> Splitters:
    """buckets - 1 entries of a sample (SAMPLE rows or so), evenly spread over its order."""
    t = sample.select("t1", "t2", "doc", "place").limit(4 * SAMPLE).toArrow()
    cols = [t.column(c).to_numpy() for c in ("t1", "t2", "doc", "place")]
    cols = [cols[0].view(np.uint64), cols[1].view(np.uint64), _unsigned(cols[2]), cols[3].astype(np.uint64)]
    order = multikey_order(cols)
    if not len(order) or buckets < 2:
        return np.zeros((0, 4), np.uint64)
    at = order[np.unique(np.linspace(0, len(order) - 1, buckets + 1).astype(np.int64)[1:-1])]
    return np.stack([c[at] for c in cols], axis=1)


def _sampled_rows(docs: DataFrame, share: float) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)) + 1)


def _partitioned(entries: DataFrame, splitters: Splitters) -> DataFrame:
    return entries.repartitionById(len(splitters) + 1, F.col("bucket"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted by document and place, with those that touch made one."""
    held: tuple[int, int, int] | None = None
    for batch in batches:
        doc, a, b = (batch.column(c).to_numpy() for c in ("doc", "a", "b"))
        if not len(doc):
            continue
        if held:
            doc, a, b = np.r_[held[0], doc], np.r_[held[1], a], np.r_[held[2], b]
        nth = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
        reach = np.maximum.accumulate(b + (nth << 44)) - (nth << 44)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])]
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], len(doc)] - 1
        held = int(doc[-1]), int(a[start[-1]]), int(reach[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[start[:-1]]), pa.array(a[start[:-1]]), pa.array(reach[stop[:-1]])], ["doc", "a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["doc", "a", "b"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 16 << 20):
        out = []
        for doc, body, spans in zip(*columns(batch), batch.column("spans").to_pylist()):
            spans = sorted((s["a"], s["b"]) for s in spans or ())
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            rest = b"".join([*kept, body[at:]])
            out.append((doc, len(body), len(body) - len(rest), spans, rest))
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x[3]] for x in out], kind), pa.array([hashlib.sha256(x[4]).hexdigest() for x in out]), pa.array([x[4] for x in out], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
        )


def _with_marks(docs: DataFrame, marks: DataFrame, column: str, width: int, how: str) -> DataFrame:
    """docs with a column of marks of ``width`` bytes each: broadcast up to a checked size, by a shuffle beyond it."""
    right = marks.withColumnRenamed("doc", "doc_id").select("doc_id", column)
    size = right.agg(F.sum(F.lit(width) * F.size(column) + 32)).first()[0] or 0
    return docs.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, "doc_id", how)


def repeats(docs: DataFrame) -> DataFrame:
    """doc, a, b: the maximal runs of bytes [a, b) of each document that are to be removed."""
    body = texts(docs).where("doc_id is not null")
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = max(1, size // 31)
    buckets = max(2, -(-total // BUCKET))

    def entries(rows: DataFrame, make: Callable, schema: str, s: Splitters) -> DataFrame:
        return mapped(rows, lambda it: make(it, s), schema)

    none = np.zeros((0, 4), np.uint64)
    share = SAMPLE / total
    s1 = _splitters(entries(_sampled_rows(body, share), _suffixes, ENTRY, none), buckets)
    first = settle(_partitioned(entries(body, _suffixes, ENTRY, s1), s1).mapInArrow(lambda it: _compared(it, s1, False), "doc long, a long, b long"), "suffix-marks")

    asked = settle(first.where("b < 0").groupBy("doc").agg(F.collect_list("a").alias("asked")), "suffix-asked")
    rows = _with_marks(body, asked, "asked", 8, "inner")
    n_asked = asked.agg(F.sum(F.size("asked"))).first()[0] or 0
    buckets = max(2, -(-5 * n_asked // BUCKET))
    wide = ENTRY + ", extra long"
    s2 = _splitters(entries(_sampled_rows(rows, SAMPLE / max(1, 5 * n_asked)), _cores, wide, none), buckets)
    windows = settle(_partitioned(entries(rows, _cores, wide, s2), s2).mapInArrow(lambda it: _windows(it, s2), "t1 long, t2 long, doc long, place long"), "suffix-strings")

    n_windows = windows.count()
    s3 = _splitters(windows.where(F.pmod(F.xxhash64("doc", "place"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, n_windows))) + 1), max(2, -(-n_windows // BUCKET)))
    third = _partitioned(windows.mapInArrow(lambda it: _dealt(it, s3), ENTRY), s3).mapInArrow(lambda it: _compared(it, s3, True), "doc long, a long, b long")

    marks = first.where("b >= 0").union(third)
    return marks.repartition("doc").sortWithinPartitions("doc", "a").mapInArrow(_merged, "doc long, a long, b long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of a, b), kept_sha256 and kept (the remaining bytes) of every row."""
    marks = settle(repeats(docs).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary"
    return mapped(_with_marks(texts(docs), marks, "spans", 16, "left"), _cut, schema)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
