import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, frame, rows
from tracewright.llm import automata, common, prefixes, repair

CONV = "conv_id long, turn long, role string, text string"


def talks(seed=3, n=60, most=9):
    """Conversations that share first turns, with copies, gaps, null and odd values, and one that is long."""
    rng = random.Random(seed)
    out, told = [], []
    for i in range(n):
        said = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "No!", "what now", "A?", "", " \t", None, "é. ü", "long " * 30])) for _ in range(rng.randint(1, most))]
        if told and rng.random() < 0.5:
            said = rng.choice(told)[: rng.randint(1, most)] + said[: rng.randint(0, 3)]
        told.append(said)
        out += [(i if i != 7 else -8, t * rng.choice([1, 1, 2]) if t else rng.choice([0, None]), r, x) for t, (r, x) in enumerate(said)]
    out += [(1000, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(700)]
    return out


def ordered(data):
    """conv_id -> rows; rows of one turn keep the order that the operator gives them only if they are equal, so such turns are made distinct by the caller."""
    out = {}
    for c, t, r, x in data:
        out.setdefault(c, []).append((t, r, x))
    return {c: sorted(v, key=lambda e: (e[0] is not None, e[0] or 0)) for c, v in out.items()}


def one_a_turn(data):
    """Without different rows of one turn, whose order is the operators' own."""
    seen = {}
    return [d for d in data if seen.setdefault(d[:2], d[2:]) == d[2:]]


def trie(data):
    own = {c: [(r or "", x or "") for _, r, x in v] for c, v in ordered(data).items() if c is not None}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    @cache
    def below(p):
        own_ = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        found = [below(k) for k in kids.get(p, [])]
        return sum(x for x, _ in found) + (0 if found else 1), sum(x for _, x in found) + own_

    out = set()
    for p in sorted(members, key=len, reverse=True):  # deep ones first, so that below() need not recurse far
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("most", "broadcast"), [(30_000, 200_000), (40, 200_000), (5, 0), (1, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, most, broadcast):
    """The same nodes whether first turns fit in one piece or are parted again and again."""
    monkeypatch.setattr(prefixes, "MOST", most)
    monkeypatch.setattr(prefixes, "BUCKET", 3 * most)
    monkeypatch.setattr(prefixes, "BROADCAST_ROWS", broadcast)
    data = one_a_turn(talks())
    assert nodes(prefixes.conversation_trie(spark.createDataFrame(data, CONV))) == trie(data)


def test_trie_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "MOST", 20)
    data = [(5 * i, t, "user", f"shared {t}") for i in range(40) for t in range(12)] + [(5 * i, 12, "user", f"own {i % 7}") for i in range(40)]
    assert nodes(prefixes.conversation_trie(spark.createDataFrame(data, CONV))) == trie(data)


def test_trie_awkward_rows(spark):
    data = [(None, 0, "user", "lost"), (3, None, None, None), (3, None, None, None), (4, 1, "user", "x" * 2_000_000), (14, 0, "a", "b")]
    d = spark.createDataFrame([(*r, 1, "z", True) for r in data], CONV + ", pos int, k1 string, n boolean")
    assert nodes(prefixes.conversation_trie(d)) == trie(data)
    assert prefixes.conversation_trie(spark.createDataFrame([], CONV)).count() == 0


def damage(data):
    out = []
    for c, t, r, x in data:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else "".join(ch for ch in x if ch not in ".!?") if code == 2 else x
        r = "user" if code == 4 else r
        out += [(c, t, r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def fits(roles):
    s = "".join(roles)
    s = s[1:] if s.startswith("s") else s
    return not roles or (len(s) > 0 and s == "ua" * (len(s) // 2))


def cheapest(faults, turns):
    """Least (cost, initials, result) over all edits, by trying them; results are cut off above the cost of deleting all."""
    best = [(10**9, "", None)]

    def go(i, cost, audit, out, inserted):
        if cost > best[0][0]:
            return
        r = [x[0][:1] for x in out]
        if len(r) > 1 and r[-1] == "s" or (len(r) > 1 and r[-2] + r[-1] not in ("su", "ua", "au")) or (r and r[0] not in ("s", "u")):
            return
        if i == len(turns):
            if fits(r) and (cost, audit) < best[0][:2]:
                best[0] = (cost, audit, list(out))
        else:
            role, text = turns[i]
            cut = 5 if faults[i] == "truncated" else 0
            go(i + 1, cost + 2, audit + "D", out, 0)
            if faults[i] in (None, "truncated"):
                go(i + 1, cost + cut, audit + "K", [*out, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + cut, audit + "R", [*out, (to, text)], 0)
        if inserted < 2:
            for to in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (to, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best[0]


def repairs(data, solve):
    made, out = ordered(damage(data)), {}
    for c in {r[0] for r in data}:
        turns = [t for t, _, _ in made.get(c, [])]
        said = [(r, x) for _, r, x in made.get(c, [])]
        faults, seen = [], set()
        for r, x in said:
            body = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((r, x))
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, left = solve(faults, said)
        text = "\n".join(f"{r}:{x}" for r, x in left)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, data):
    d = repair.damaged(spark.createDataFrame(data, CONV))
    return {r.conv_id: tuple(r)[1:] for r in repair.digest(d, repair.plans(d)).collect()}


def test_repairs_match_brute_force(spark):
    data = one_a_turn([r for r in talks(seed=9, n=80, most=5) if r[0] != 1000]) + [(None, 3, "system", "Begin."), (None, 4, "user", "Go.")]
    data += [(2000 + k, t, r, x) for k, turns in enumerate(itertools.product([("user", "Q?"), ("assistant", "A."), ("system", "S.")], repeat=3)) for t, (r, x) in enumerate(turns)]
    assert found(spark, data) == repairs(data, cheapest)


def test_repaired_turns_are_those_hashed(spark):
    data = one_a_turn(talks(seed=4, n=30))
    d = repair.damaged(spark.createDataFrame(data, CONV))
    answers = repair.plans(d)
    said = {}
    for r in sorted(repair.repaired(d, answers).collect(), key=lambda r: (r.conv_id, r.place)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.digest(d, answers).collect():
        assert hashlib.sha256("\n".join(said.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert fits([x[:1] for x in said.get(r.conv_id, [])])


def test_repair_awkward_rows(spark):
    data = [(1, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 2_000_000 + "."), (3, 5, "tool", "odd.")]
    d = spark.createDataFrame([(*r, 1, "z", "K") for r in data], CONV + ", cost int, kind string, audit string")
    d = repair.damaged(d)
    got = repair.digest(d, repair.plans(d)).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3]
    empty = repair.damaged(spark.createDataFrame([], CONV))
    assert repair.digest(empty, repair.plans(empty)).count() == 0
    assert repair._shared("abcde", "abcxe") == 3 and repair._shared("", "a") == 0 and repair._shared("aa", "aaa") == 2


def cut_words(data, n=20):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1] or "") for r in data):
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            s = tuple(w[p : p + n])
            if s in seen:
                gone[p : p + n] = [True] * n
            seen.add(s)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed=6):
    """Texts that share stretches of all lengths with different words on either side, near copies, periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(400)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            a, n = rng.randrange(360), rng.choice([8, 15, 19, 20, 21, 25, 40, 90])
            parts += [word() for _ in range(rng.randint(0, 6))] + base[a : a + n]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(parts), None, None, None))
    common = [(100 + i, " ".join([f"own{i}x{k}" for k in range(25)] + base[:60] + [f"end{i}x{k}" for k in range(25)]), None, None, None) for i in range(30)]
    return out + common + [(200, "a b " * 300, None, None, None), (201, "x " + "a b " * 40, None, None, None), (202, "word " * 3000, None, None, None)]


@pytest.mark.parametrize(("pieces", "shard", "broadcast", "step"), [(1_000, 60_000, 32 << 20, 1 << 20), (4, 300, 100, 64), (1, 50, 32 << 20, 1000)])
def test_removed_words_match_brute_force(spark, monkeypatch, pieces, shard, broadcast, step):
    """One shard or many, anchors that are searched by longer ones, automata broadcast or joined."""
    for name, value in (("PIECES", pieces), ("SHARD", shard), ("PACK", shard), ("BROADCAST_BYTES", broadcast), ("STEP", step)):
        monkeypatch.setattr(automata, name, value)
    data = passages() + [(500 + r[0], *r[1:]) for r in rows()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automata.digest(automata.deduplicate(frame(spark, data))).collect()}
    assert got == cut_words(data)
    assert sum(x[1] for x in got.values()) > 1000


def test_no_row_holds_a_shard(spark, monkeypatch):
    """What is written between stages is small however large the shards are: Parquet is read thousands of rows at a time."""
    widest = []

    def settle(df, label):
        out = common.settle(df, label)
        widest.extend((label, c, out.agg(F.max(F.octet_length(c))).first()[0] or 0) for c, kind in out.dtypes if kind == "binary")
        return out

    monkeypatch.setattr(automata, "settle", settle)
    data = passages()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automata.digest(automata.deduplicate(frame(spark, data))).collect()}
    assert got == cut_words(data)
    assert widest and all(n <= 8 * 2 * automata.WINDOW for _, _, n in widest), widest


def test_kept_words_and_spans(spark):
    data = passages(8)
    for r in automata.deduplicate(frame(spark, data)).collect():
        w = (dict((d[0], d[1]) for d in data)[r.doc_id]).split()
        gone = {k for s in r.spans for k in range(s.a, s.b)}
        assert r.kept == " ".join(x for k, x in enumerate(w) if k not in gone) and r.n_removed == len(gone)


def test_word_removal_awkward_rows(spark):
    d = awkward(spark)
    got = automata.digest(automata.deduplicate(d)).collect()
    assert len(got) == d.count() and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert automata.digest(automata.deduplicate(frame(spark, []))).count() == 0
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))  # 2.7 MB
    data = [(1, long, None, None, None), (2, long[1_000_000:1_500_000], None, None, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automata.digest(automata.deduplicate(frame(spark, data))).collect()}
    assert got == cut_words(data)
