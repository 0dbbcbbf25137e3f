"""Operator 5, best-fit packing planned over a histogram of lengths.

Documents are tokenised once; what is kept of a piece is its place, length and checksum. The histogram of
piece lengths (at most ``capacity`` counts, whatever the corpus) goes to the driver, where best-fit decreasing
is run over counts: bins that are alike are one group. The plan is a list of runs, "pieces of length L with
rank r0 <= r < r0 + n go to these sequences", and pieces take their slots by joining on length and rank.

Defined results: a null or empty text has one piece, the separator alone. A null doc_id is packed like any
other. Repeated rows are packed once each, ranked in no fixed order among themselves. An empty table gives an
empty result. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import columns, mapped, of_worker, release, settle, small_batches, texts

CAPACITY = 2048
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Whitespace-separated chunks whose ids a worker remembers, and the longest chunk that it does.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 48
#: Ranks are dealt in buckets of about so many pieces, so a common length is not one task's work.
BUCKET_ROWS = 2_048
#: Ranks of a length that meet a plan too large to broadcast at a time.
CHUNK = 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """ids of a text by a tokenizer whose pre-tokenizer never joins across ASCII white space.

    Such a tokenizer gives a text the ids of its white-space chunks in order, so each distinct chunk is encoded
    once for a worker process; ``join`` returns packed little-endian unsigned 32-bit ids. The tokenizer also
    ignores case and keeps a run of punctuation apart from letters and digits before it, so chunks are looked
    up in lower case, and a chunk that is new as a whole is put together from its head and its tail. That a
    tokenizer is like this is tried on PROBES when it is loaded; any other gets whole texts.
    """

    PROBES = (
        b"Ab cD  e.f, (g) h!? 1,234.5 x", "Été über\tNAÏVE\n\nstraße.\r\n İI 😀!! 中文 end".encode(),
        b"word. word, word; word) word] word\" &&& a&&& b%%% $$$c *** d***", b" lead", b"trail ", b"a\x0bb\x0cc", b"don't can't we'll it's 'quoted'", b"-- a-b_c/d\\e @f #g",
    )

    #: Punctuation that can be split off behind a letter or digit.
    TAIL = b".,;:!?|&$#%*\")]}"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word; none if the tokenizer does not mark them
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        del vocabulary
        release()
        self.apart = self._holds()

    @classmethod
    def of_worker(cls, path: str) -> ChunkIds:
        """One for all tasks that a worker process runs."""
        return of_worker(f"chunk ids {path}", lambda: cls(path))

    def _whole(self, bodies: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([b.decode() for b in bodies], add_special_tokens=False)]

    def _holds(self) -> bool:
        """Whether PROBES get the same ids by chunks as whole."""
        self.apart = True
        held = self.join([*self.PROBES]) == self._whole([*self.PROBES])
        self.known, self.older = {}, {}
        return held

    def _encode(self, chunks: list[bytes]) -> None:
        """Chunks that are one word of letters, or one run of punctuation, are encoded many in one text: a word's last token says that it is."""
        one = [c for c in chunks if c.isalpha() or not c.strip(self.TAIL) or c.decode().isalpha()]
        for start in range(0, len(one), 4096):
            self._encode_joined(one[start : start + 4096])
        many = set(chunks).difference(one)
        self._encode_each([*many])

    def _encode_each(self, chunks: list[bytes]) -> None:
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            self.known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)))

    def _encode_joined(self, chunks: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(chunks).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(chunks) or (len(stops) and stops[-1] != len(ids)):
            return self._encode_each(chunks)
        packed, at = ids.tobytes(), 0
        for c, stop in zip(chunks, (4 * stops).tolist()):
            self.known[c] = packed[at:stop]
            at = stop
        return None

    def _learn(self, new: set[bytes]) -> None:
        known, older = self.known, self.older
        parts, whole = {}, []
        for c in new:
            if c in older:
                known[c] = older[c]
                continue
            head = c.rstrip(self.TAIL)
            if len(head) == len(c) or not head[-1:].isalnum():
                whole.append(c)
            else:
                parts[c] = head, c[len(head) :]
        ends = {x for pair in parts.values() for x in pair if x not in known}
        for x in [x for x in ends if x in older]:
            known[x] = older[x]
            ends.discard(x)
        self._encode([*{*whole, *ends}])
        for c, (head, tail) in parts.items():
            known[c] = known[head] + known[tail]

    def join(self, bodies: list[bytes]) -> list[bytes]:
        if not self.apart:
            return self._whole(bodies)
        split = [(b if b"<|" in b else b.lower()).split() for b in bodies]  # special tokens are told by their case
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.older = {}, self.known
        known = self.known
        new = set().union(*split).difference(known)
        self._learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for c in new:
            if len(c) > CACHE_CHARS:
                del known[c]
        return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    ids_of = ChunkIds.of_worker(path)
    for batch in small_batches(batches, 1 << 20):
        ids, bodies = columns(batch)
        rows = []
        for doc, packed in zip(ids, ids_of.join(bodies)):
            packed += b"\0\0\0\0"
            for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                part = packed[at : at + 4 * capacity]
                rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, in one pass without a shuffle."""
    return mapped(texts(docs), lambda it: _pieces(it, tokenizer, capacity), PIECES_SCHEMA)


Run = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, pieces a sequence, offset), and the number of sequences.

    Bins with the same room are kept as ranges of sequence numbers. Of the bins with the least room that a
    length fits in, each takes as many pieces as it can before the next is used, which is what best fit does
    with one piece at a time.
    """
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, how many)
    sequences = 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            room.setdefault(free, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for free in sorted(f for f in room if f >= length):
            each = free // length
            while left and room.get(free):
                first, n = room[free].pop()
                whole = min(n, left // each)
                if whole:
                    runs.append((length, rank, whole * each, first, each, capacity - free))
                    put(free - each * length, first, whole)
                    rank, left = rank + whole * each, left - whole * each
                used = whole
                if used < n and 0 < left < each:
                    runs.append((length, rank, left, first + used, left, capacity - free))
                    put(free - left * length, first + used, 1)
                    rank, left, used = rank + left, 0, used + 1
                if used < n:
                    put(free, first + used, n - used)
                    if not left:
                        break
            if not room.get(free):
                room.pop(free, None)
            if not left:
                break
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            if whole:
                runs.append((length, rank, whole * each, sequences, each, 0))
                put(capacity - each * length, sequences, whole)
                rank, sequences = rank + whole * each, sequences + whole
            if rest:
                runs.append((length, rank, rest, sequences, rest, 0))
                put(capacity - rest * length, sequences, 1)
                sequences += 1
    return runs, sequences


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length.

    Pieces of a length are dealt by row into as many buckets as their count asks for, ranks are counted in buckets
    and shifted by the counts of the buckets before. Rows are numbered, so ties, null and repeated ids are dealt alike.
    """
    dealing = pieces.sparkSession.createDataFrame([(n, -(-count // BUCKET_ROWS)) for n, count in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(dealing), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")  # a row for each length, at most ``capacity``
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    return dealt.withColumn("own", own).join(shifts, ["length", "bucket"]).withColumn("rank", F.col("shift") + F.col("own") - 1).drop("own", "shift", "bucket", "row")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = settle(cut(docs, tokenizer or default_tokenizer(), capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "length long, r0 long, n long, first_sequence long, each long, first_offset long")
    placed = ranked(pieces, histogram)
    if len(runs) <= 64 * capacity:  # runs grow with the number of lengths, not with the corpus
        placed = placed.join(F.broadcast(slots), "length")
    else:  # a length's pieces meet its runs by CHUNK ranks at a time
        chunks = F.sequence(F.floor(F.col("r0") / CHUNK), F.floor((F.col("r0") + F.col("n") - 1) / CHUNK))
        placed = placed.withColumn("chunk", F.floor(F.col("rank") / CHUNK)).join(slots.withColumn("chunk", F.explode(chunks)), ["length", "chunk"]).drop("chunk")
    placed = placed.where("rank >= r0 and rank < r0 + n")
    nth = F.col("rank") - F.col("r0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("each")) * F.col("length")).alias("offset"),
    )
