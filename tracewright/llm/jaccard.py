"""Operator 9, n-gram Jaccard join: size-aware, heavy-light, exact.

Two documents link when 100 * |intersection| >= 75 * |union| over their sets of 5-word shingles. Identical sets
are one class, found by a 128-bit fingerprint. Classes meet under keys:

* light sets (fewer shingles than a boundary) under every 2-subset of their prefix, which linked sets that
  are not identical always share, since they have at least three shingles in common;
* heavy sets, and light ones that a heavy one could link with, under every single shingle of their prefix:
  the inverted lists.

A prefix is the part of a set, in one order for all sets, that linked sets cannot both miss. Shingles come
rarest first in that order, by a map of counts over all sets, so lists of passages that many documents share
hardly arise. The order changes cost alone, never results. The boundary is where the cost of subsets and lists, over the histogram of
sizes, is least.

A list first gives links to its least member (a star, linear in the list). Stars that hold make components;
after that only pairs of a list that are in different components are looked at, the members outside the
list's main component against all. Of documents that fill long lists whole sets are counted first: one of them links
with no other component of that crowd unless enough of its shingles occur there, and those shingles, rarest
first, have short prefixes of their own, so heavily edited copies of a text give few pairs among themselves;
others must have met enough in their prefixes. What is left is ruled out by shared lists and bucket counts or verified on whole texts; none is capped.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its
own component. A row with a null doc_id gets its shingle count and a null component. Rows with the same doc_id
are one document. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import columns, mapped, rows_bound, settle, small_batches, texts
from tracewright.llm.components import components
from tracewright.llm.packed import pack, unpack
from tracewright.llm.shingles import Met, WordHashes, fingerprint, shingle_sets

#: Links: NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: The map of frequent shingles has 2^14 to 2^25 places of a byte, SPARSE for each shingle. What is too rare to fit keeps its place by hash.
MAP_BITS, SPARSE = (14, 25), 8
#: Ids of the documents to verify are broadcast up to so many (8 MB); beyond, they meet the documents by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents with a fifth of their prefix in lists this long, over several components, are a crowd: their whole sets are looked at before they give pairs.
CROWD = 8
#: Ranges of hashes that counts are packed by, hashes that one task sums at a time, and the length from which lists weigh alike in the choice of a boundary.
PARTS, SUM_KEYS, LONG = 256, 2_000_000, 16
#: Members of a list that a task meets strays with at a time.
PART = 256


def least_overlap(size: int) -> int:
    """Shingles that a set of this size shares at least with any set it links with."""
    return -(-NUM * size // DEN)


def prefix_length(size: int, subset: int = 1) -> int:
    """So many first shingles hold at least ``subset`` that are common to both of two linked sets."""
    return min(size, size - least_overlap(size) + subset)


def _in_order(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rarest first by the levels of the map, by hash within a level. Sets come sorted by hash."""
    level = frequent[shingles >> np.uint64(65 - len(frequent).bit_length())]
    return shingles[np.argsort(level, kind="stable")] if level.any() else shingles


def packed_parts(keys: np.ndarray, counts: np.ndarray, parts: int) -> dict[str, list]:
    """Sorted hashes and their counts, packed by ``parts`` (a power of two) equal ranges of hashes."""
    part = (keys >> np.uint64(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    cuts = [(int(a), int(b)) for a, b in zip(edges[full], edges[full + 1])]
    return {"part": full.tolist(), "n": [b - a for a, b in cuts], "keys": [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], "counts": [pack(counts[a:b]) for a, b in cuts]}


def _split(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed counts dealt into more ranges."""
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_pydict(packed_parts(np.cumsum(unpack(keys), dtype=np.uint64), unpack(counts), parts), schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _summed(group: pa.Table, least: int) -> pa.Table:
    """Of a range of hashes those that ``least`` sets or more have, with the level of their count; and one row (no key) with what all counts sum up to, plainly and weighed by themselves (LONG at most)."""
    keys = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in group.column("keys").to_pylist()])
    counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n = np.add.reduceat(counts[order], start)
    heavy = n >= least
    level = np.log2(n[heavy] / least).astype(np.int32) + 1
    none = pa.nulls(int(heavy.sum()), pa.float64())
    rows = [(pa.array(keys[start][heavy].view(np.int64)), pa.array(level), none, none), (pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([float(n.sum())]), pa.array([float((n * np.minimum(n, LONG)).sum())]))]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(r), ["key", "level", "sets", "met"]) for r in rows])


SCAN = "doc_id long, n_shingles long, fa long, fb long, buckets binary, part int, n long, keys binary, counts binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every row its set's size and fingerprint; besides (with a null size) the shingles of the first half of each set, by hash, with how many sets have them, packed by PARTS ranges of hashes.

    A prefix is a quarter of a set and frequent shingles make way in it for others, which the half holds unless
    most of a set is frequent.
    """
    known, seen, held, total = WordHashes.of_worker(), Met(), [], 0
    kinds = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in SCAN.split(", ")]

    def batch_of(length: int, data: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(data[c], t) if c in data else pa.nulls(length, t) for c, t in kinds], [c for c, _ in kinds])

    def counted() -> pa.RecordBatch:
        rows = packed_parts(*np.unique(np.concatenate(held), return_counts=True), PARTS)
        return batch_of(len(rows["part"]), rows)

    for batch in small_batches(batches):
        ids, bodies = columns(batch)
        sets = shingle_sets(bodies, known)
        prints = [fingerprint(s) for s in sets]
        buckets = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for s in sets]
        yield batch_of(len(ids), {"doc_id": ids, "n_shingles": [len(s) for s in sets], "fa": [a for a, _ in prints], "fb": [b for _, b in prints], "buckets": buckets})
        for s, (p, _) in zip(sets, prints):
            if len(s) and not seen.before(p):
                held.append(s[: len(s) // 2 + 1])
                total += len(held[-1])
        if total > 1_000_000:
            yield counted()
            held, total = [], 0
    if held:
        yield counted()


def _postings(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, boundary: int) -> Iterator[pa.RecordBatch]:
    """key, node and, of a 2-subset, the place of its second shingle; -1 of a single shingle."""
    known, seen = WordHashes.of_worker(), Met()
    for batch in small_batches(batches):
        keys, nodes, places = [], [], []
        for s in shingle_sets(columns(batch)[1], known):
            if not len(s) or seen.before(node := fingerprint(s)[0]):
                continue
            s, own = _in_order(s, frequent), []
            if len(s) < boundary:
                first = s[: prefix_length(len(s), 2)]
                i, j = np.triu_indices(len(first), 1)
                low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                own.append((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + (low >> np.uint64(7))))
                places.append(j.astype(np.int32))
            if 100 * len(s) >= NUM * boundary:
                own.append(s[: prefix_length(len(s))])
                places.append(np.full(len(own[-1]), -1, np.int32))
            own = np.concatenate(own)
            keys.append(own.view(np.int64))
            nodes.append(np.full(len(own), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, places)], ["key", "node", "at"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by key and node: those of keys with two nodes or more, each once, with the list's least node."""
    key, least, least_at, last, told = None, None, None, None, False
    for batch in batches:
        keys, nodes, places = (batch.column(c).to_numpy() for c in ("key", "node", "at"))
        if not len(keys):
            continue
        new_key = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
        new = new_key | np.r_[key is None or keys[0] != key or nodes[0] != last, nodes[1:] != nodes[:-1]]
        starts = np.flatnonzero(new_key)
        run = np.cumsum(new_key) - 1
        of_run = lambda x, before: np.where(run < 0, 0 if before is None else before, x[starts[np.maximum(run, 0)]] if len(starts) else 0)  # noqa: E731, B023
        lead, lead_at = of_run(nodes, least), of_run(places, least_at).astype(np.int32)
        member = new & (nodes != lead)
        mk, mn, ma, ml = keys[member], nodes[member], places[member], lead[member]
        # a list's least node is told once, before its second
        head = np.r_[True, mk[1:] != mk[:-1]] if len(mk) else np.zeros(0, bool)
        if len(mk) and told and mk[0] == key:
            head[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[mk[head], mk]), pa.array(np.r_[ml[head], mn]), pa.array(np.r_[lead_at[member][head], ma]), pa.array(np.r_[ml[head], ml])], ["key", "node", "at", "lead"])
        told = bool((len(mk) and mk[-1] == keys[-1]) or (told and keys[-1] == key and not new_key.any()))
        key, least, least_at, last = keys[-1], lead[-1], lead_at[-1], nodes[-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes.of_worker()
    for batch in small_batches(batches):
        sets = shingle_sets(columns(batch)[1], known)
        n = [len(s) for s in sets]
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("doc_id", "c"))], ["key", "rep", "c"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle counts in 256 hash buckets leave room for a link: two sets share no more of a bucket than the lesser count (255 stands for any number from there on)."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("buckets_a", "buckets_b"))
        least = np.minimum(x, y)
        most = least.sum(1, dtype=np.int64)
        sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        good = (least == 255).any(1) | (DEN * most >= NUM * (sizes - most))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, kept = WordHashes.of_worker(), {}
    for batch in small_batches(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
        out = []
        for x, y, u, v in zip(a, b, ta, tb):
            if x not in kept:
                kept = {x: shingle_sets([u], known)[0]}
            s, t = kept[x], shingle_sets([v], known)[0]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and DEN * both >= NUM * (len(s) + len(t) - both):
                out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def choose_boundary(histogram: dict[int, int], list_length: float) -> int:
    """The size from which sets use inverted lists: the least sum of subsets made below and list entries met above."""
    tops = [2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64]

    def cost(boundary: int) -> float:
        total = 0.0
        for size, n in histogram.items():
            if size < boundary:
                p = prefix_length(size, 2)
                total += n * p * (p - 1) / 2
            if 100 * size >= NUM * boundary:
                total += n * prefix_length(size) * list_length
        return total

    return min(tops, key=cost)


def frequent_shingles(counted: DataFrame, least: int) -> DataFrame:
    """key and level (a scale of powers of two from ``least`` on) of frequent shingles, and the sums that _summed gives. A range of hashes is one task's work, so there are as many as the count of hashes asks for."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    parts = PARTS
    while parts * SUM_KEYS < total:
        parts *= 2
    if parts > PARTS:
        counted = mapped(counted, lambda it: _split(it, parts), "part int, n long, keys binary, counts binary")
    return settle(counted.groupBy("part").applyInArrow(lambda t: _summed(t, least), "key long, level int, sets double, met double"), "jaccard-frequent")


def frequent_map(heavy: DataFrame) -> np.ndarray:
    """A map of bytes by the leading bits of hashes: the level of the most frequent shingle that falls there.

    Where the largest map would be too small the least level is raised until the most frequent ones fit: the order
    of shingles changes cost alone.
    """
    levels = {r["level"]: r["shingles"] for r in heavy.groupBy("level").agg(F.count("*").alias("shingles")).collect()}  # 64 rows at most
    first = 1
    while (fits := sum(n for k, n in levels.items() if k >= first)) * SPARSE > 1 << MAP_BITS[1]:
        first += 1
    bits = min(MAP_BITS[1], max(MAP_BITS[0], (SPARSE * fits).bit_length()))
    at = F.shiftrightunsigned("key", 64 - bits).alias("at")
    table = heavy.where(F.col("level") >= first).groupBy(at).agg(F.max("level").alias("level")).toArrow()  # no more rows than the map has places
    out = np.zeros(1 << bits, np.uint8)
    out[table.column("at").to_numpy()] = table.column("level").to_numpy()
    return out


def verified(pairs: DataFrame, buckets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b, size_a, size_b) of doc_ids, those whose texts link. Bucket counts rule most others out before texts move."""
    half = lambda c: buckets.select(F.col("doc_id").alias(c), F.col("buckets").alias(f"buckets_{c}"))
    pairs = pairs.join(half("a"), "a").join(half("b"), "b").select("a", "b", "size_a", "size_b", "buckets_a", "buckets_b")
    pairs = settle(mapped(pairs, _possible, "a long, b long").distinct(), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if rows_bound(needed, BROADCAST_ROWS):
        needed = F.broadcast(needed)
    held = settle(texts(docs).join(needed, "doc_id", "left_semi"), "jaccard-texts")
    side = lambda c: held.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return settle(mapped(full, _verify, "a long, b long").distinct(), "jaccard-links")


def link(docs: DataFrame, *, frequent_from: int = 4, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scanned = settle(mapped(texts(docs), _scan, SCAN), "jaccard-sets")
    sets = scanned.where("n_shingles is not null").select("doc_id", "n_shingles", "fa", "fb")
    buckets = scanned.where("n_shingles > 0 and doc_id is not null").select("doc_id", "buckets")
    counted = frequent_shingles(scanned.where("n_shingles is null").select("part", "n", "keys", "counts"), frequent_from)
    classes = settle(sets.where("n_shingles > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "jaccard-classes")
    if boundary is None:
        sizes = {int(r["s"]): r["n"] for r in classes.groupBy(F.round(F.exp(F.round(F.log("size") * 16) / 16)).alias("s")).agg(F.count("*").alias("n")).collect()}  # sizes on a log scale: a few hundred rows
        met = counted.agg((F.sum("met") / F.sum("sets")).alias("x")).first()["x"]
        boundary = choose_boundary(sizes, 1.0 + (met or 0.0))
    shared_map = docs.sparkSession.sparkContext.broadcast(frequent_map(counted.where("key is not null")))
    posted = mapped(texts(docs), lambda it: _postings(it, shared_map.value, boundary), "key long, node long, at int")
    shared = settle(mapped(posted.repartition("key").sortWithinPartitions("key", "node"), _shared, "key long, node long, at int, lead long"), "jaccard-lists")
    reps = classes.select(F.col("fa").alias("node"), "rep", "size")

    # stars: where a list's least node shares much of its prefix with another, they are tried at once
    star = shared.where("node <> lead").groupBy("lead", "node").agg(F.count("*").alias("n"))
    star = star.join(reps.select(F.col("node").alias("lead"), F.col("rep").alias("a"), F.col("size").alias("size_a")), "lead").join(reps.select("node", F.col("rep").alias("b"), F.col("size").alias("size_b")), "node")
    fits = (DEN * F.least("size_a", "size_b") >= NUM * F.greatest("size_a", "size_b")) & (F.col("a") != F.col("b"))
    links = verified(star.where(fits & (20 * F.col("n") >= F.least("size_a", "size_b"))).select("a", "b", "size_a", "size_b"), buckets, docs)
    found = components(links)

    # lists whose members are not all in one component
    member = settle(shared.select("key", "node", "at").join(reps, "node").select("key", "rep", "size", "at"), "jaccard-members")
    member = settle(still_open(member, found), "jaccard-open")
    met = member.groupBy("rep").agg(F.count_if(F.col("at") < 0).alias("met"), F.count_if(F.col("in_list") >= CROWD).alias("in_crowd"), F.first("size").alias("size"), F.first("c").alias("c"))
    met = settle(met, "jaccard-met")
    crowd = settle(met.where(20 * F.col("in_crowd") >= F.col("size")).select("rep", "c"), "jaccard-crowd")
    common = settle(common_shingles(crowd, docs), "jaccard-common")
    supported = settle(support(crowd, common), "jaccard-support")

    # stars again, now of the member of a crowd that has most in common with it
    central = member.join(supported, "rep").withColumn("share", F.col("support") / F.col("size"))
    centre = central.groupBy("key").agg(F.max_by(F.struct("rep", "size", "c"), F.struct("share", "rep")).alias("x"))
    near = central.join(centre, "key").where("c <> x.c").select(F.col("x.rep").alias("a"), F.col("x.size").alias("size_a"), F.col("rep").alias("b"), F.col("size").alias("size_b"))
    near = near.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
    fits = DEN * F.least("size_a", "size_b") >= NUM * F.greatest("size_a", "size_b")
    links = links.union(verified(near.where(fits & (20 * F.col("n") >= F.least("size_a", "size_b"))).select("a", "b", "size_a", "size_b"), buckets, docs))
    found = components(links)

    # pairs across components, by how many lists they share
    member = still_open(member.select("key", "rep", "size", "at"), found).drop("in_list")
    member = settle(member.join(met.select("rep", "met").join(supported, "rep", "left"), "rep"), "jaccard-supported")
    member, stray = with_strays(member, "jaccard-strays")
    m, s = member.alias("m"), stray.alias("s")
    fits = DEN * F.least("m.size", "s.size") >= NUM * F.greatest("m.size", "s.size")
    need = F.ceil((F.col("m.size") + F.col("s.size")) * NUM / (NUM + DEN))
    light = F.greatest("m.size", "s.size") < boundary
    # two light sets meet by 2-subsets: all that is common lies from the first such on, which holds two of it
    behind = lambda x: F.col(f"{x}.size") - F.col(f"{x}.at") + 1
    by_two = light & (F.col("m.at") >= 0) & (F.least(behind("m"), behind("s")) >= need)
    # no pair shares more lists than the one that meets fewer of them; the rest as in can_link
    by_one = ~light & (F.col("m.at") < 0) & (F.least("m.met", "s.met") + F.greatest(rest(F.col("m.size")), rest(F.col("s.size"))) >= need)
    fits = fits & (by_two | by_one)
    fits = fits & (F.col("m.support").isNull() | F.col("s.support").isNull())  # pairs within the crowd follow
    once = (F.col("m.c") == F.col("s.main")) | (F.col("m.rep") > F.col("s.rep"))
    cross = m.join(s, (F.col("m.key") == F.col("s.key")) & (F.col("m.part") == F.col("s.part")) & (F.col("m.c") != F.col("s.c")) & fits & once)
    low, high = F.least(F.struct("m.rep", "m.size"), F.struct("s.rep", "s.size")), F.greatest(F.struct("m.rep", "m.size"), F.struct("s.rep", "s.size"))
    cross = cross.select(low.alias("x"), high.alias("y")).select(F.col("x.rep").alias("a"), F.col("x.size").alias("size_a"), F.col("y.rep").alias("b"), F.col("y.size").alias("size_b"))
    cross = cross.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
    cross = cross.where(can_link(boundary)).select("a", "b", "size_a", "size_b")
    within = crowd_pairs(common, supported.join(met.select("rep", "size"), "rep"), found)
    more = verified(cross.union(within), buckets, docs)
    found = components(links.union(more))

    comp = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(comp, ["fa", "fb"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def still_open(member: DataFrame, found: DataFrame) -> DataFrame:
    """Of members (key, rep, size, at) of lists, those of lists over several components, with their component c and the list's length."""
    member = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", "at", F.coalesce("component", "rep").alias("c"))
    keys = member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("in_list")).where("c0 <> c1").select("key", "in_list")
    return member.join(keys, "key")


def with_strays(member: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Members of lists (key, rep, c, ...) dealt into parts of about PART of a list, and those outside their list's main component, repeated for each part: (key, part) joins them evenly however long a list is."""
    lists = member.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    told = settle(member.join(lists, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), label)
    stray = told.where("c <> main").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return told, stray


def common_shingles(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """key, rep, in_crowd: of each document of a crowd (rep, c), the shingles that one of another component in the crowd has too, and how many have them."""
    ids = F.broadcast(crowd) if rows_bound(crowd, BROADCAST_ROWS) else crowd
    rows = mapped(texts(docs).join(ids.withColumnRenamed("rep", "doc_id"), "doc_id"), _members, "key long, rep long, c long")
    rows = settle(rows, "jaccard-shingles")
    common = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("in_crowd")).where("c0 <> c1").select("key", "in_crowd")
    return rows.select("key", "rep").join(common, "key")


def support(crowd: DataFrame, common: DataFrame) -> DataFrame:
    """rep and support: how many common shingles a document of the crowd has. It shares no more with any of another component there."""
    found = common.groupBy("rep").agg(F.count("*").alias("n"))
    return crowd.select("rep").join(found, "rep", "left").select("rep", F.coalesce("n", F.lit(0)).alias("support"))


def crowd_pairs(common: DataFrame, supported: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of the crowd, of different components, that can link.

    All that two of them share is among their common shingles, so these are sets of their own, with prefixes that
    are short where few of them can be missed: rarest first, the first that both have must leave enough behind
    it on both sides.
    """
    least = F.ceil(F.col("size") * NUM / DEN)
    rows = common.join(supported.where(F.col("support") >= least), "rep")
    at = F.row_number().over(Window.partitionBy("rep").orderBy("in_crowd", "key")) - 1
    rows = rows.withColumn("behind", F.col("support") - at).where(F.col("behind") >= least)
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", "behind", F.coalesce("component", "rep").alias("c"))
    rows = settle(rows, "jaccard-crowd-prefixes")
    rows, stray = with_strays(rows, "jaccard-crowd-strays")
    m, s = rows.alias("m"), stray.alias("s")
    need = F.ceil((F.col("m.size") + F.col("s.size")) * NUM / (NUM + DEN))
    fits = (DEN * F.least("m.size", "s.size") >= NUM * F.greatest("m.size", "s.size")) & (F.least("m.behind", "s.behind") >= need)
    once = (F.col("m.c") == F.col("s.main")) | (F.col("m.rep") > F.col("s.rep"))
    pairs = m.join(s, (F.col("m.key") == F.col("s.key")) & (F.col("m.part") == F.col("s.part")) & (F.col("m.c") != F.col("s.c")) & fits & once)
    return pairs.select(F.col("m.rep").alias("a"), F.col("s.rep").alias("b"), F.col("m.size").alias("size_a"), F.col("s.size").alias("size_b")).distinct()


def rest(size: Column) -> Column:
    """A set's shingles past its prefix."""
    return F.ceil(size * NUM / DEN) - 1


def can_link(boundary: int) -> Column:
    """Whether sets with sizes size_a and size_b that meet in n lists can still link.

    Of the two prefixes one ends first in the common order. All that both sets have up to there is in both
    prefixes and so among the n; past it that set has only its size less its prefix. Two light sets, which meet by
    subsets, are always tried.
    """
    need = F.ceil((F.col("size_a") + F.col("size_b")) * NUM / (NUM + DEN))
    return (F.greatest("size_a", "size_b") < boundary) | (F.col("n") + F.greatest(rest(F.col("size_a")), rest(F.col("size_b"))) >= need)
