"""Operator 7, stupid-backoff language-model scores, computed relationally over packed tables.

Exploded n-grams of a corpus are many times its size, so rows hold arrays. Documents are put in blocks of some
megabytes. A block asks for each of its distinct n-grams of each order once: hashes, sorted, cut by hash range.
The count table of an order is partitioned by the same ranges; where all requests for a range meet, counts over
the whole corpus are summed and go back to the blocks that asked, which sum scores per document.

S(w | u v) = c(u v w) / c(u v) if c(u v w) >= min_count, else backoff * S(w | v); at the end c(w) / N. A
document's score is the sum of log S over its words (A-Z in lower case, split at white space).

n-grams are told apart by their 64-bit hashes, at every size (``key_bits`` takes fewer leading bits). Defined results: a null or empty text has
no words and score 0. A null doc_id is returned as such. Repeated rows are counted and scored each. Columns
other than doc_id and text are never read.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import columns, mapped, own_path, small_batches, texts
from tracewright.llm.packed import pack, unpack
from tracewright.llm.shingles import WordHashes, ngrams, words_of

BLOCK_BYTES = 12 << 20
#: Words of the corpus for each hash range.
RANGE_WORDS = 1 << 20
#: A block of documents.
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_words", pa.int64()), ("vocabulary", pa.binary()), ("ranks", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents by blocks: how many words each has, the block's words (hashes, the frequent ones first, then by hash, as differences) and each place's rank among them. Ranks take a third of the room of compressed text."""
    known, ids, counts, hashes, size = WordHashes.of_worker(), [], [], [], 0

    def out() -> pa.RecordBatch:
        vocabulary, place, uses = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-uses, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        block = int.from_bytes(os.urandom(8), "little") >> 1
        data = (block, ids, counts, len(place), pack(np.diff(vocabulary[order], prepend=np.uint64(0))), pack(rank[place]))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(data, BLOCK)], schema=BLOCK)

    for batch in small_batches(batches):
        for doc, body in zip(*columns(batch)):
            words = words_of(body)
            ids.append(doc)
            counts.append(len(words))
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            size += len(body)
            if size >= block_bytes:
                yield out()
                ids, counts, hashes, size = [], [], [], 0
    if ids:
        yield out()


def _words(blocks: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """Of each block its number, documents, how many words each has, and the words' hashes."""
    for block, ids, counts, vocabulary, ranks in zip(*(blocks.column(c).to_pylist() for c in ("block", "ids", "counts", "vocabulary", "ranks"))):
        yield block, ids, np.array(counts, np.int64), np.cumsum(unpack(vocabulary), dtype=np.uint64)[unpack(ranks).astype(np.int64)]


def _grams(counts: np.ndarray, flat: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of an order in order of place, none across documents, and where they end."""
    if len(flat) < k:
        return flat[:0], np.zeros(0, np.int64)
    g, end = ngrams(flat, k) >> np.uint64(64 - bits), np.arange(k - 1, len(flat))
    if k > 1:
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        same = owner[k - 1 :] == owner[: len(g)]
        g, end = g[same], end[same]
    return g, end


def _requests(batches: Iterator[pa.RecordBatch], order: int, bits: int, range_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, _, sizes, flat in _words(batch):
            for k in range(1, order + 1):
                keys, counts = np.unique(_grams(sizes, flat, k, bits)[0], return_counts=True)
                ranges = (keys >> np.uint64(bits - range_bits)).astype(np.int64)
                edges = np.searchsorted(ranges, np.arange((1 << range_bits) + 1))
                full = np.flatnonzero(edges[1:] > edges[:-1])
                packed = [(pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for a, b in zip(edges[full], edges[full + 1])]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                data = ([k] * len(full), full.tolist(), [block] * len(full), [p[0] for p in packed], [p[1] for p in packed])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds)], ["n", "range", "block", "keys", "counts"])


def _count(group: pa.Table) -> pa.Table:
    """A range of an order's count table, and from it what each block asked for."""
    keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in group.column("keys").to_pylist()]
    counts = [unpack(x) for x in group.column("counts").to_pylist()]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts).astype(np.float64)).astype(np.uint64)
    answers, at = [], 0
    for k in keys:
        answers.append(pack(total[inverse[at : at + len(k)]]))
        at += len(k)
    return pa.table({"n": group.column("n"), "range": group.column("range"), "block": group.column("block"), "totals": pa.array(answers, pa.binary())})


def _score(block: pa.Table, answers: pa.Table, order: int, bits: int, n_words: int, backoff: float, min_count: int) -> pa.Table:
    out = {"doc_id": [], "n_words": [], "log_score": [], "n_full": []}
    told: dict[int, list] = {}
    for n, r, t in zip(*(answers.column(c).to_pylist() for c in ("n", "range", "totals"))):
        told.setdefault(n, []).append((r, t))
    for _, ids, counts, flat in _words(block):
        words = len(flat)
        seen, last = [], []  # by order: the count of the n-gram that ends at a word (0 where there is none), and the words where one ends
        for k in range(1, order + 1):
            g, end = _grams(counts, flat, k, bits)
            _, inverse = np.unique(g, return_inverse=True)
            totals = np.concatenate([np.zeros(0, np.uint64), *(unpack(t) for _, t in sorted(told.pop(k, []), key=lambda x: x[0]))])
            own = np.zeros(words)
            own[end] = totals[inverse]
            seen.append(own)
            last.append(end)
        log_s = np.log(np.maximum(seen[0], 1) / max(n_words, 1))
        level, place = np.ones(words, np.int64), np.zeros(words, np.int64)
        for k in range(2, order + 1):
            place[last[k - 1]] = k  # the longest n-gram that the document has room for
        for k in range(2, order + 1):
            here = last[k - 1]
            c, h = seen[k - 1][here], seen[k - 2][here - 1]
            good = c >= min_count
            log_s[here] = np.where(good, np.log(np.maximum(c, 1) / np.maximum(h, 1)), log_s[here] + math.log(backoff))
            level[here[good]] = k
        ends = np.cumsum(counts)
        total = np.r_[0.0, np.cumsum(log_s)]
        full = np.r_[0, np.cumsum((level == place) & (place > 1))]
        out["doc_id"] += ids
        out["n_words"] += counts.tolist()
        out["log_score"] += (total[ends] - total[ends - counts]).tolist()
        out["n_full"] += (full[ends] - full[ends - counts]).tolist()
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "log_score": pa.array(out["log_score"], pa.float64()), "n_full": pa.array(out["n_full"], pa.int64())})


def _bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """df, written once to the shared folder in buckets of a column: rows that meet answers by it are not shuffled. Tasks write few rows, so files are no more than rows."""
    spark = df.sparkSession
    path = own_path(spark, label)
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = min(4096, max(8, 2 * df.rdd.getNumPartitions()))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).format("parquet").saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, min_count: int = 2, block_bytes: int = BLOCK_BYTES, key_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs) and n_full (words scored without backing off) of every row."""
    blocks = _bucketed(mapped(texts(docs), lambda it: _blocks(it, block_bytes), "block long, ids array<long>, counts array<long>, n_words long, vocabulary binary, ranks binary"), "block", "lm_blocks")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = key_bits or 64
    range_bits = max(0, (max(1, n_words) // RANGE_WORDS).bit_length())
    asked = blocks.mapInArrow(lambda it: _requests(it, order, bits, range_bits), "n int, range int, block long, keys binary, counts binary")
    answers = asked.groupBy("n", "range").applyInArrow(_count, "n int, range int, block long, totals binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _score(b, a, order, bits, n_words, backoff, min_count), "doc_id long, n_words long, log_score double, n_full long")
    return scored
