import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, frame, rows
from tracewright.llm import langid, lmscore, packed, packing, quality, toxicity


def test_text_statistics(spark):
    def brute(t):
        import re

        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)

    texts = ["a b c d e f a b c d e g", "x\nx\n \n \ny\rz\nx", "é à# *$ %&|<>", "", None, "a " * 50, "n\x85b\xa0c d e f g", "a\x1cb c"]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(100 + r[0], *r[1:]) for r in rows()]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_stats(frame(spark, data)).collect()}
    assert got == {r[0]: brute(r[1]) for r in data}


def test_rules_tell_junk(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(30, 90))), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(rng.randint(30, 90))), "en", "s", 0) for i in range(80)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in clean + junk if r[0] % 2], "doc_id long, quality int, toxic int")
    out = quality.quality_verdicts(frame(spark, clean + junk), labels).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)
    none = quality.quality_verdicts(frame(spark, clean), labels.where("false"))
    assert none.where("kept").count() == len(clean)
    assert quality.quality_verdicts(awkward(spark), labels).count() == awkward(spark).count()
    assert quality.quality_verdicts(frame(spark, []), labels).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    data = rows() + [(500 + i, "same length text number", "en", "s", 0) for i in range(40)] + [(900, "a<|endoftext|>b It's we'll'd. <|ENDOFTEXT|> É́ 12,5;; ñ'S", "en", "s", 0)]
    out = packing.pack(frame(spark, data), capacity=64).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in data}
    want = {(d, k, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for d, x in ids.items() for k, s in enumerate(range(0, len(x), 64))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64


def test_plan_is_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(0, 80))]
        runs, n = packing.plan(dict(Counter(lengths)), 32)
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= x]
            if fit:
                b = min(fit, key=lambda b: bins[b])
                bins[b] -= x
            else:
                bins.append(32 - x)
        assert n == len(bins)
        used = Counter()
        for length, r0, count, first, each, offset in runs:
            for i in range(count):
                at = offset + (i % each) * length
                used[first + i // each] += length
                assert at + length <= 32
        assert sum(used.values()) == sum(lengths) and all(v <= 32 for v in used.values())


def test_packing_awkward_rows(spark):
    d = awkward(spark)
    assert packing.pack(d).select("sequence_id").count() >= d.count()
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("key_bits", [None, 64])
def test_backoff_scores_match_brute_force(spark, key_bits):
    data = rows()
    got = {r.doc_id: (r.n_words, r.log_score) for r in lmscore.score(frame(spark, data), block_bytes=2000, key_bits=key_bits).collect()}
    words = {r[0]: tuple((r[1] or "").encode().lower().split()) for r in data}
    counts = [Counter() for _ in range(4)]
    for w in words.values():
        for k in (1, 2, 3):
            counts[k].update(w[i : i + k] for i in range(len(w) - k + 1))
    total = sum(map(len, words.values()))
    for doc, w in words.items():
        score = 0.0
        for i in range(len(w)):
            k = min(3, i + 1)
            while k > 1 and counts[k][w[i - k + 1 : i + 1]] < 2:
                k -= 1
                score += math.log(0.4)
            score += math.log(counts[k][w[i - k + 1 : i + 1]] / (counts[k - 1][w[i - k + 1 : i]] if k > 1 else total))
        assert got[doc][0] == len(w) and abs(got[doc][1] - score) < 1e-6 * max(1, abs(score))
    assert lmscore.score(awkward(spark)).count() == awkward(spark).count()
    assert lmscore.score(frame(spark, [])).count() == 0


def test_pack_numbers():
    for x in (np.array([], np.uint64), np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)):
        assert (packed.unpack(packed.pack(x)) == x).all()


def test_posteriors_are_exact():
    rng = np.random.default_rng(1)
    e, a = rng.random((700, 3)).astype(np.float32) + 0.01, rng.random((3, 3)).astype(np.float32) + 0.1
    ends, start = np.array([0, 5, 5, 70, 199, 700]), 0
    got = langid.posteriors(e, a, ends)
    for end in ends:
        x, n = e[start:end].astype(float), end - start
        f, b, v = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3)
        for i in range(n):
            v = (v @ a) * x[i]
            f[i] = v = v / v.sum()
        for i in range(n - 2, -1, -1):
            b[i] = a @ (b[i + 1] * x[i + 1])
            b[i] /= b[i].sum()
        if n:
            q = f * b
            assert np.abs(q / q.sum(1, keepdims=True) - got[start:end]).max() < 1e-4
        start = end


def test_languages_and_switches(spark):
    rng = random.Random(8)
    make = {"aa": lambda: "".join(rng.choice(["ka", "ti", "mo", "lu"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["sch", "er", "ung", "ei"]) for _ in range(3))}
    data = [(i, " ".join(make[lang]() for _ in range(40)), lang, "s", 0) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    mixed = [(900, " ".join([make["aa"]() for _ in range(60)] + [make["bb"]() for _ in range(20)]), None, "s", 0), (901, None, "aa", "s", 0), (902, "123 --- 456", "aa", "s", 0), (903, "", None, "s", 0)]
    d = frame(spark, data + mixed)
    got = {r.doc_id: r for r in langid.digest(langid.predict(d, langid.fit(d))).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].score > 0.9 for r in data)
    assert got[900].lang_pred == "aa" and 15 <= got[900].n_switched <= 25
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (901, 902, 903))
    assert got[5].held_out == (zlib.crc32(b"5") % 3 == 1)
    assert {r.lang_pred for r in langid.predict(d, langid.fit(d.where("false"))).collect()} == {"und"}
    assert langid.predict(awkward(spark), langid.fit(d)).count() == awkward(spark).count()


def test_maximal_segments():
    rng = random.Random(3)

    def brute(v, a, b):
        best = max(((sum(v[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i, j = -best[1], -best[2]
        return [*brute(v, a, i), (i, j), *brute(v, j, b)]

    for _ in range(200):
        v = [rng.choice([-1.5, -0.7, -2.1, 0.9, 1.3, 2.05]) + rng.random() * 0.01 for _ in range(rng.randint(0, 13))]
        assert [s[:2] for s in toxicity.segments(np.array(v))] == brute(v, 0, len(v))


def test_toxic_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    bad = ["grmbl", "zounds", "blimey"]
    data = []
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(bad))
        data.append((i, " ".join(w), "en", "s", 0))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    d = frame(spark, data + [(700, None, None, None, None), (701, "", None, None, None)])
    out = toxicity.digest(toxicity.score(d, toxicity.fit(d, labels))).collect()
    assert all(r.predicted == int(r.doc_id % 6 == 0 and r.doc_id < 600) for r in out)
    assert toxicity.fit(d, labels.where("toxic = 0")).weights == {}
    assert toxicity.score(awkward(spark), toxicity.Model()).count() == awkward(spark).count()


def test_toxic_stems(spark):
    """Words of one stem, each form too rare to be told by itself, and forms that no labelled text has."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    data, bad, forms = [], set(range(0, 900, 6)), 0
    for i in range(900):
        w = [word() for _ in range(60)]
        if i in bad:
            for _ in range(5):
                w.insert(rng.randrange(60), "zélô" + "".join(rng.choice("abcdefgh") for _ in range(3)))
                forms += 1
        data.append((i, " ".join(w), "fr", "s", 0))
    data.append((900, " ".join([word() for _ in range(30)] + ["Zélô!"] * 3 + [word() for _ in range(30)]), "fr", "s", 0))  # a stem is no token
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(900)], "doc_id long, quality int, toxic int")
    d = frame(spark, data)
    model = toxicity.fit(d, labels)
    out = toxicity.digest(toxicity.score(d, model)).collect()
    assert len(out) == 901 and any(r.held_out for r in out if r.doc_id in bad)
    assert all(r.predicted == int(r.doc_id in bad) for r in out)
    assert "zélô" in model.stems and len({t for t in model.weights if t.startswith("zélô".encode())}) < forms / 10


def test_languages_without_spaces(spark):
    """Every letter of a text counts, however few white spaces it has."""
    assert langid.letters("Été-2x_e\u0301a".encode()) == ["été", "x", "ea"] and langid.letters(b"--- 1") == []
    assert langid.letters(("ab" * 45).encode()) == ["ab" * 20, "ab" * 20, "ab" * 5]
    rng = random.Random(9)
    make = {"aa": lambda: "".join(rng.choice(["ka", "ti", "mo", "lu"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["sch", "er", "ung", "ei"]) for _ in range(3))}
    data = [(i, " ".join(make[lang]() for _ in range(40)), lang, "s", 0) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    words = [make["aa"]() for _ in range(8)] + [make["bb"]() for _ in range(40)]
    glued = [(900 + k, x.join(words), None, "s", 0) for k, x in enumerate([" ", "\xa0", "_", "-", "/", ""])]
    d = frame(spark, data + glued)
    got = {r.doc_id: r for r in langid.digest(langid.predict(d, langid.fit(d))).collect()}
    assert all(got[r[0]].lang_pred == "bb" for r in glued)
    same = {(got[i].n_words, got[i].n_switched, round(got[i].score, 6)) for i in range(900, 905)}
    assert len(same) == 1 and got[900].n_words == 48 and 6 <= got[900].n_switched <= 10
    assert got[905].n_words == -(-sum(map(len, words)) // 40) and got[905].n_switched >= 1


def test_empty_tables_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + "x" * 200_000
    d = frame(spark, [(1, long, "aa", "s", 0), (2, "ka ti mo lu", "bb", "s", 0), (2, "ka ti mo lu", "bb", "s", 0), (None, "no id here", None, None, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    nothing = frame(spark, [])
    for fit, run in ((langid.fit, langid.predict), (lambda x: toxicity.fit(x, labels), toxicity.score)):
        out = run(d, fit(d)).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
        assert run(nothing, fit(nothing)).count() == 0 and run(nothing, fit(d)).count() == 0
    assert {r.n_words for r in langid.predict(d, langid.fit(d)).collect() if r.doc_id == 1} <= {0, 65_000}


def test_samples_are_shared_evenly():
    assert langid.even_share({"a": 10, "b": 10_000, "c": 40}, 3_000) == 2_950
    assert langid.even_share({"a": 10}, 3_000) == 10 and langid.even_share({}, 5) == 0.0
    assert langid.even_share({"a": 900, "b": 900}, 1_000) == 500


def test_rules_go_on_after_an_imprecise_one():
    """A group that no threshold tells apart is put aside, and one that can be told is still learnt."""
    rng = np.random.default_rng(4)
    n = 900
    x = {"a": rng.random(n), "b": rng.random(n)}
    bad = (x["b"] > 0.93) | ((x["a"] > 0.5) & (rng.random(n) < 0.3))
    rules = quality.learn_rules(x, bad, np.arange(n) % 3 == 0)
    assert rules and any(t.feature == "b" and t.above and 0.9 < t.threshold < 0.97 for r in rules for t in r)
    assert bad[quality._any_of(rules, x, n)].mean() >= 0.85


def test_blocks_of_words_are_not_shuffled(spark):
    """Blocks lie in buckets where answers meet them: requests and answers alone are shuffled."""
    docs = spark.createDataFrame([(i, f"a b c d{i % 3}") for i in range(40)], "doc_id long, text string")
    scored = lmscore.score(docs, block_bytes=64)
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert scored.count() == 40
