"""Operator 12, conversation structure repair: the cheapest edits that make roles alternate, and what they leave.

1. Rows are dealt by conversation without their texts (role, two hashes, what is wrong with the text) and
   read in order as a stream: counts, and a signature with one character a row (its role, whether it must go, whether
   it is truncated), last row first.
2. Signatures are range-partitioned and sorted, so those that begin alike meet in one task one after the other. The
   last one's path through the prefix trie is a stack of layers of the dynamic program: a layer holds, for each state of
   the grammar `(s?(ua)+)?`, the least cost of the rows after it and the edit that starts it. A signature pops down to
   what it shares with the one before, pushes a layer for each further row, and reads its answer off the stack. Signatures
   run backwards because the edits' ties do: of edits that cost the same from one state, each has another
   initial, so the least initial gives the least string, which does not hold for programs that run forwards.
3. Answers and texts meet by conversation, sorted with the answer first, and the repaired conversation is written (or
   hashed) as its rows pass.

Range partitions cut large groups of equal signatures by conv_id. No task holds more of a conversation than its signature and audit (a
byte a row each, as the result does) and its stack.

Defined results: in roles, texts and in the text that damage is drawn by, a null is one space; rows of the same turn are
ordered by role and then by hashes of role and text; repeated rows are rows each (so the later one is a duplicate); rows
without a conv_id are one conversation, whose conv_id is null; an empty table has no rows; columns other than conv_id,
turn, role and text are never read. Roles count by their first character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import mapped, settle
from tracewright.llm.prefixes import CRC32

WHITE = " \t\n\x0b\x0c\r"
#: Costs of an edit, and of a truncated row that is kept.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Signatures of a task.
PART = 200_000
#: States of the output so far: nothing, system, ends with user, ends with assistant. What a role makes of each; what is next where it may be chosen.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
Layer = tuple[tuple[int, ...], str]  #: for each state the cost of what follows, and the first edit ('.': none)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone (the row is dropped) of every row after damage, a repeated row twice."""
    one = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    c = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return c.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(12), "text", "role")})


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "d1", "d2"]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of each conversation of rows (as damaged() gives them), and its signature."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    light = _keyed(rows).select("conv_id", "turn", "role", "d1", "d2", "gone", fault.alias("fault")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "d1", "d2").orderBy(F.col("turn").asc_nulls_first())) > 1
    light = light.withColumn("fault", F.when(again & (F.col("fault") != 1), 2).otherwise(F.col("fault")))
    light = light.sortWithinPartitions("conv_id", *_order(), F.col("fault") == 2).select("conv_id", F.col("turn").cast("long").alias("turn"), F.left("role", F.lit(1)).alias("role"), "gone", "fault")
    return mapped(light, _signed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place -> a row a conversation."""
    legal = {"su", "ua", "au"}
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    on, started, done = None, False, []
    counts, illegal, first, last, distinct, before, sig = [0] * 4, 0, None, None, 0, None, bytearray()

    def flush() -> None:
        done.append((on, last - first + 1 - distinct if distinct else 0, counts[1], counts[2], counts[3], illegal, bytes(reversed(sig)).decode()))

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names)

    for batch in batches:
        for conv, turn, role, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "fault"))):
            if not started or conv != on:
                if started:
                    flush()
                on, started = conv, True
                counts, illegal, first, last, distinct, before, sig = [0] * 4, 0, None, None, 0, None, bytearray()
            if gone:
                continue
            counts[fault] += 1
            if before is not None and before + role not in legal:
                illegal += 1
            before = role
            if turn is not None and turn != last:
                first, last, distinct = turn if first is None else first, turn, distinct + 1
            sym = role if role in ("s", "u", "a") else "o"
            sig += (b"x" if fault in (1, 2) else sym.upper().encode() if fault == 3 else sym.encode())
        if done:
            yield batch_of()
    if started:
        flush()
        yield batch_of()


def _settled(base: list[tuple[int, str]]) -> Layer:
    """A layer from each state's best edit that uses up the row, with insertions tried before it."""
    best = list(base)
    for _ in range(2):  # no more than two insertions in one place are ever cheapest
        best = [min(b, (INSERT + best[_NEXT[q]][0], "I")) for q, b in enumerate(base)]
    return tuple(b[0] for b in best), "".join(b[1] for b in best)


_FAR = 1 << 40
END = _settled([(0, "."), (_FAR, "."), (_FAR, "."), (0, ".")])
_KNOWN: dict[tuple, Layer] = {}


def layer(after: tuple[int, ...], sym: str) -> Layer:
    """The layer of a row, from the costs of what follows it. Layers that differ by a constant are one: there are few."""
    low = min(after)
    key = (tuple(c - low for c in after), sym)
    found = _KNOWN.get(key)
    if found is None:
        base = []
        for q in range(4):
            options = [(DELETE + key[0][q], "D")]
            if sym != "x":
                cut = CUT if sym.isupper() else 0
                options.append((RENAME + cut + key[0][_NEXT[q]], "R"))
                if (to := _AFTER[q].get(sym.lower())) is not None:
                    options.append((cut + key[0][to], "K"))
            base.append(min(options))
        found = _KNOWN[key] = _settled(base)
    return tuple(c + low for c in found[0]), found[1]


def edits(stack: list[Layer], signature: str) -> str:
    """The cheapest edits of a signature (last row first) whose layers are stacked up, first row first."""
    out, at, state = [], len(signature), 0
    while True:
        edit = stack[at][1][state]
        if edit == ".":
            return "".join(out)
        out.append(edit)
        if edit == "I":
            state = _NEXT[state]
            continue
        at -= 1
        if edit == "R":
            state = _NEXT[state]
        elif edit == "K":
            state = _AFTER[state][signature[at].lower()]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in order -> each with its cost and audit, by layers shared with the one before."""
    stack, before, cost, audit = [END], "", 0, ""
    for batch in batches:
        costs, audits = [], []
        for sig in batch.column("signature").to_pylist():
            if sig != before:
                shared = _shared(sig, before)
                del stack[shared + 1 :]
                for sym in sig[shared:]:
                    stack.append(layer(stack[-1][0], sym))
                before, cost, audit = sig, stack[-1][0][0], edits(stack, sig)
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*(c for c in batch.schema.names if c != "signature"), "cost", "audit"])


def _shared(a: str, b: str) -> int:
    """How many first characters two strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[low:mid], low) else (low, mid - 1)
    return low


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_ANSWER = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost and audit of every conversation of rows (as damaged() gives them)."""
    signed = settle(signatures(rows), "repair-signatures")
    parts = max(1, -(-signed.count() // PART))
    sorted_ = signed.repartitionByRange(parts, "signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return mapped(sorted_, _answered, _ANSWER)


def _met(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's answer, then its rows in order."""
    texts = _keyed(rows.where("not gone"))
    a = answers.select("conv_id", F.lit(0).alias("kind"), *STATS)
    t = texts.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"), "turn", "role", "text", "d1", "d2")
    both = a.unionByName(t, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return both.select("conv_id", "kind", *STATS, "role", "text")


def _turns(audit: str, at: int, state: int, row: tuple[str, str] | None) -> tuple[list[tuple[str, str]], int, int]:
    """What the edits from ``at`` make of the next row (None: of the end), with the edit and the state after it."""
    made = []
    while at < len(audit):
        edit = audit[at]
        if edit != "I" and row is None:
            break
        at += 1
        if edit == "I":
            state = _NEXT[state]
            made.append(("assistant" if state == 3 else "user", ""))
            continue
        if edit == "R":
            state = _NEXT[state]
            made.append(("assistant" if state == 3 else "user", row[1]))
        elif edit == "K":
            state = _AFTER[state][row[0][:1]]
            made.append(row)
        break
    return made, at, state


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, str]], bool]]:
    """(answer, some repaired turns, whether the conversation is over), as rows pass."""
    answer, at, state = None, 0, 0
    for batch in batches:
        for kind, conv, role, text, *stats in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "role", "text", *STATS))):
            if kind == 0:
                if answer is not None:
                    yield answer, _turns(answer[-1], at, state, None)[0], True
                answer, at, state = (conv, *stats), 0, 0
            else:
                made, at, state = _turns(answer[-1], at, state, (role, text))
                yield answer, made, False
    if answer is not None:
        yield answer, _turns(answer[-1], at, state, None)[0], True


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *STATS, "repaired_sha256"]
    sha, any_, done = hashlib.sha256(), False, []

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-2]), *(pa.array(c, pa.string()) for c in cols[-2:])], names)

    for answer, made, over in _conversations(batches):
        for role, text in made:
            sha.update(f"\n{role}:{text}".encode() if any_ else f"{role}:{text}".encode())
            any_ = True
        if over:
            done.append((*answer, sha.hexdigest()))
            sha, any_ = hashlib.sha256(), False
            if len(done) == 10_000:
                yield batch_of()
    if done:
        yield batch_of()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, size, done = 0, 0, []

    def batch_of() -> pa.RecordBatch:
        conv, places, roles, texts = zip(*done)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(places, pa.int64()), pa.array(roles), pa.array(texts)], ["conv_id", "place", "role", "text"])

    for answer, made, over in _conversations(batches):
        for role, text in made:
            done.append((answer[0], place, role, text))
            place, size = place + 1, size + len(text) + 64
        place = 0 if over else place
        if size > 1 << 20:
            yield batch_of()
            size = 0
    if done:
        yield batch_of()


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv_id, place, role, text of every turn that the edits leave or make."""
    return mapped(_met(rows, answers), _written, "conv_id long, place long, role string, text string")


def digest(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mapped(_met(rows, answers), _hashed, _ANSWER + ", repaired_sha256 string")


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _dp() -> str:
    """The program over a row's symbol ``x`` and the layer ``a`` after it, whose states are {c, e}: cost and edits."""
    put = lambda cost, initial, q: f"{{'c': a[{q + 1}].c + {cost}, 'e': '{initial}' || a[{q + 1}].e}}"
    cut = f"(CASE WHEN x = upper(x) THEN {CUT} ELSE 0 END)"
    best = []
    for q in range(4):
        keep = " ".join(f"WHEN '{r}' THEN {put(cut, 'K', to)}" for r, to in _AFTER[q].items())
        best.append(f"CASE WHEN x = 'x' THEN {put(DELETE, 'D', q)} ELSE list_min([{put(DELETE, 'D', q)}, {put(f'{cut} + {RENAME}', 'R', _NEXT[q])}, CASE lower(x) {keep} ELSE {put(_FAR, 'Z', q)} END]) END")
    add = lambda n, q: f"{{'c': b[{q + 1}].c + {n * INSERT}, 'e': '{'I' * n}' || b[{q + 1}].e}}"
    inserted = ", ".join(f"list_min([{add(0, q)}, {add(1, _NEXT[q])}, {add(2, _NEXT[_NEXT[q]])}])" for q in range(4))
    return f"list_transform([[{', '.join(best)}]], lambda b: [{inserted}])[1]"


_END = "[{'c': 0, 'e': ''}, {'c': 10, 'e': 'II'}, {'c': 5, 'e': 'I'}, {'c': 0, 'e': ''}]"
#: Edits as a cheapest string per state, layer by layer from the last row; then a walk along the edits to write what they leave.
ORACLE = f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, rtrim(text, {_SPACE}) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS b FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND b || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
 list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(r) ELSE r END ORDER BY rn DESC) AS sig, list({{'role': role, 'text': text}} ORDER BY rn) AS said FROM f GROUP BY conv_id),
l AS (SELECT conv_id, 0 AS i, {_END} AS a FROM s UNION ALL SELECT conv_id, i + 1, {_dp()} FROM (SELECT l.conv_id, i, a, sig[i + 1] AS x FROM l JOIN s ON s.conv_id IS NOT DISTINCT FROM l.conv_id WHERE i < len(sig))),
g AS (SELECT s.*, a[1].c AS cost, a[1].e AS audit FROM l JOIN s ON s.conv_id IS NOT DISTINCT FROM l.conv_id WHERE i = len(sig)),
k AS (SELECT conv_id, 0 AS i, 0 AS rn, '' AS last, CAST([] AS VARCHAR[]) AS out FROM g UNION ALL
 SELECT conv_id, i + 1, rn + (e <> 'I')::INT, CASE e WHEN 'D' THEN last WHEN 'K' THEN left(said[rn + 1].role, 1) ELSE CASE last WHEN 'u' THEN 'a' ELSE 'u' END END,
  CASE e WHEN 'D' THEN out WHEN 'K' THEN list_append(out, said[rn + 1].role || ':' || said[rn + 1].text) ELSE list_append(out, CASE last WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE said[rn + 1].text END) END
 FROM (SELECT k.*, said, audit, substr(audit, i + 1, 1) AS e FROM k JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id WHERE i < length(audit))),
w AS (SELECT g.*, sha256(array_to_string(out, chr(10))) AS repaired_sha256 FROM g JOIN k ON g.conv_id IS NOT DISTINCT FROM k.conv_id AND i = length(audit))
SELECT c.conv_id, coalesce(CAST(gaps AS BIGINT), 0) AS gaps, coalesce(CAST(blank AS BIGINT), 0) AS blank, coalesce(CAST(duplicate AS BIGINT), 0) AS duplicate, coalesce(CAST(truncated AS BIGINT), 0) AS truncated, coalesce(CAST(illegal AS BIGINT), 0) AS illegal, coalesce(CAST(cost AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""
