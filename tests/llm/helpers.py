"""Small documents with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=5, n=30):
    """Words from a small vocabulary, with exact and near copies, shared passages, long, empty and null texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(12, 160))]
        text = " ".join(words)
        if i % 5 == 1 and out:  # near copy
            w = out[-1].split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 7 == 3:
            text = text + "\n" + passage
        out.append(text)
    out += [out[0], out[0].upper(), "", None, "one two", "one two", " \t\n", "é" * 300, passage, "word " * 2000, "x" * 5000]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(out)]


def frame(spark, data=None, schema=DOCS_SCHEMA):
    return spark.createDataFrame(rows() if data is None else data, schema)


def awkward(spark):
    """Null ids, a repeated row, and extra columns named like ones that operators make."""
    data = [(*r, "x", 1, True) for r in rows(n=8)] + [(None, "a text without an id that is long enough to be a document", None, None, None, None, None, None)]
    data.append(data[0])
    return spark.createDataFrame(data, DOCS_SCHEMA + ", score string, key long, kept boolean")


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(data):
    sets = {r[0]: shingle_set(r[1]) for r in data}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def spans(text, kinds, by_start):
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m)]
    found.sort(key=(lambda x: x[:2]) if by_start else (lambda x: (x[1], x[0])))
    joined = ",".join(f"{n}:{a}:{b}" for a, _, n, b in found)
    counts = Counter(x[2] for x in found)
    return tuple(counts[n] for n, _, _ in kinds), hashlib.sha256(joined.encode()).hexdigest(), joined


def removed(data, length=100):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1] or "") for r in data):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
