"""Word shingles as 64-bit hashes, by whole texts in Python workers."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from tracewright.llm.common import of_worker

WORDS = 5
_C1, _C2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for as many words as fit."""

    most = 120_000

    @classmethod
    def of_worker(cls) -> WordHashes:
        """One for all tasks that a worker process runs."""
        return of_worker("word hashes", cls)

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most and len(word) < 64:
            self[word] = h
        return h


class Met:
    """Which 64-bit numbers came before, as far as a table of fixed size (SLOTS times 8 bytes) remembers: a newer number takes the place of an older one with the same slot."""

    SLOTS = 1 << 18

    def __init__(self) -> None:
        self.table = np.zeros(self.SLOTS, np.int64)

    def before(self, x: int) -> bool:
        at = x & (self.SLOTS - 1)
        if self.table[at] == x:
            return True
        self.table[at] = x
        return False


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case, words as runs of bytes other than the six white-space bytes."""
    return text.lower().split()


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in order; the order of the words counts."""
    out = np.full(max(len(hashes) - n + 1, 0), n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : len(hashes) - n + 1 + i]) * _C1
        out ^= out >> _S
        out *= _C2
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(bodies: list[bytes], known: WordHashes, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; one of all its words if they are fewer than n; none without words."""
    words = [words_of(b) for b in bodies]
    counts = [len(w) for w in words]
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(counts))
    grams = ngrams(flat, n) if len(flat) >= n else flat[:0]
    out, at = [], 0
    for k in counts:
        out.append(_distinct(grams[at : at + k - n + 1].copy()) if k >= n else ngrams(flat[at : at + k], k) if k else flat[:0])
        at += k
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits, as two signed 64-bit numbers."""
    h = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
