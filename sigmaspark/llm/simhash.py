"""SimHash near-duplicates by a generalised pigeonhole.

The bits of a fingerprint are dealt into partitions, correlated bits together, and each
partition gets its own threshold. If the thresholds t_i add up to tau - m + 1, two
fingerprints within tau bits are within t_i bits in at least one of the m partitions.
A dynamic program picks the thresholds (-1 leaves a partition out), and with them the
number of partitions, by the candidate counts that bit statistics of all fingerprints
predict. Partitions are probed by equal keys, candidates are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, cut, drop_written, forget, fresh, portions, small_batches, table

BITS = 64
#: A bucket with more fingerprints is linked through one-bit variants instead of pairs (see ``_links``).
PAIR_BUCKET = 32


# -- fingerprints -------------------------------------------------------------------

def _fingerprint(text: str | None, shingle: int, chunk: int = 200_000) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1])
    ends = np.concatenate([ends, [len(joined)]])
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, chunk):  # bounded memory for long texts
        ones += _ones(np.array([[digest(joined[a:b], 42)] for a, b in zip(firsts[at : at + chunk], lasts[at : at + chunk], strict=True)], "<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit; a row holds 64 bits for each column."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    total = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # so many fit the counters
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, text_key (hash of the text), fp (long) for every row; ASCII lower case, white-space words, majority of XXH64 bits over all shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([_fingerprint(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id bigint, text_key bigint, fp bigint")


# -- partitions and thresholds ------------------------------------------------------

def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often both bits a and b are set, over all of them: a 64 x 64 table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column("fp").to_numpy().astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = nodes.select("fp").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints agree on bits a and b alike (on the diagonal: on bit a)."""
    if not n:
        return np.full((BITS, BITS), 0.25) + 0.25 * np.eye(BITS)
    one = np.diag(both) / n
    p11 = both / n
    p10, p01 = one[:, None] - p11, one[None, :] - p11
    return p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2


def group_bits(agree: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each takes the bit that its own bits predict best."""
    single = np.diag(agree)
    tie = agree / np.maximum(single[:, None] * single[None, :], 1e-12)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = (BITS * (k + 1)) // m - (BITS * k) // m
        own = [left.pop(0)]
        while len(own) < width:
            best = max(left, key=lambda b: (max(tie[a, b] for a in own), -b))
            left.remove(best)
            own.append(best)
        groups.append(own)
    return groups


def _matches(agree: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated chance that two fingerprints differ in at most t of these bits (a chain of pairwise statistics)."""
    if t < 0:
        return 0.0
    p, seen = [], []
    for b in bits:
        p.append(min(1.0, max([agree[b, b], *(agree[a, b] / max(agree[a, a], 1e-12) for a in seen)])))
        seen.append(b)
    ways = np.zeros(t + 1)
    ways[0] = 1.0
    for x in p:
        ways[1:] = ways[1:] * x + ways[:-1] * (1 - x)
        ways[0] *= x
    return float(ways.sum())


def allocate(n: int, agree: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The partitions probed and their thresholds: the cheapest by probes made plus candidates expected.

    For each number of partitions a dynamic program over (partition, thresholds spent)
    finds the cheapest allocation with sum tau - m + 1.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, tau + 3):
        groups = group_bits(agree, m)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, ts) in states.items():
                for t in range(-1, tau + 1):
                    probes = sum(comb(len(bits), k) for k in range(t + 1)) if t >= 0 else 0
                    c = cost + n * (probes + (t > 0)) + n * n / 2 * _matches(agree, bits, t)
                    if spent + t not in nxt or c < nxt[spent + t][0]:
                        nxt[spent + t] = (c, (*ts, t))
            states = nxt
        cost, ts = states[tau - m + 1]
        if cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]
    return best[1]


# -- links --------------------------------------------------------------------------

def _mask(bits) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _variants(c: Column, bits: list[int], t: int) -> Column:
    """``c`` and what it becomes with up to t of the bits flipped."""
    masks = [_mask(x) for k in range(t + 1) for x in combinations(bits, k)]
    return F.array(*[c.bitwiseXOR(F.lit(m)) for m in masks])


def _links(nodes: DataFrame, plan: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """a, b: links between different fingerprints within tau bits that connect whatever is connected.

    Every fingerprint is kept under its key in each partition and probes all keys within
    the partition's threshold. Buckets up to ``PAIR_BUCKET`` give pairs, which are
    verified. A larger bucket would give pairs in the square of its size; its
    fingerprints are linked through shared variants: two fingerprints are within two bits
    if and only if they share a variant at one bit or less, and at most 65 fingerprints
    have a variant in common (for tau = 1 the variant must be one of them).
    """
    entries = []
    for k, (bits, t) in enumerate(plan):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        entries.append(nodes.select(F.lit(k).alias("part"), key.alias("key"), "fp", F.lit(True).alias("home")))
        if t > 0:
            probes = F.slice(_variants(key, bits, t), 2, 1 << 30)
            entries.append(nodes.select(F.lit(k).alias("part"), F.explode(probes).alias("key"), "fp", F.lit(False).alias("home")))
    probed = reduce(DataFrame.unionAll, entries)
    sizes = cut(probed.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0"), "sizes")
    held = cut(probed.join(sizes, ["part", "key"]).select("part", "key", "fp", "home", "n"), "buckets")

    small = held.where(F.col("n") <= PAIR_BUCKET).groupBy("part", "key").agg(F.collect_list(F.struct("fp", "home")).alias("own"))
    left = small.select("own", F.explode("own").alias("x")).where("x.home")
    pairs = left.select(F.col("x.fp").alias("a"), F.explode("own.fp").alias("b")).where(F.col("a") != F.col("b"))
    found = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    hot = held.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    shared = hot.select("fp", F.explode(_variants(F.col("fp"), list(range(BITS)), 1)).alias("variant"))
    hubs = shared.groupBy("variant").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)
    hubs = hubs.withColumn("a", F.array_min("own")) if tau == 2 else hubs.where(F.array_contains("own", F.col("variant"))).withColumn("a", F.col("variant"))
    stars = hubs.select("a", F.explode("own").alias("b")).where(F.col("a") != F.col("b"))
    return found.unionAll(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _components(links: DataFrame) -> DataFrame:
    """node, root for every linked node; root is the smallest node reachable. Large-star and small-star rounds.

    Each step is written to the shared folder; what no later step reads is deleted. A
    root's many neighbours never meet in one task: their minimum is aggregated first and
    joined back, a join that Spark can split. Both steps keep what is connected, so once
    every node has one link, to a node without any, the links name the components.
    """
    edges = cut(links.select("a", "b"), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = cut(large.where("a != b"), "links")
        drop_written(edges, low)
        low = cut(down.groupBy("a").agg(F.min("b").alias("m")), "lows")
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a != b").distinct(), "links")
        drop_written(down, low)
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        ups = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
        if ups.where("up > 1 or up = 1 and least = 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, tau: int = 2, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, root, text_key for every row. component_id: the smallest doc_id reachable through links of at most ``tau`` bits;
    root: a fingerprint that names the component.

    ``tau`` is 0, 1 or 2. Null and empty texts have fingerprint zero and are linked like any
    other. Rows with a null id belong to their component; its id is null only if it has no
    other rows. Repeated rows are rows of one component. Other columns are not read. An
    empty table gives an empty result.
    """
    if tau not in (0, 1, 2):
        raise ValueError("tau is 0, 1 or 2")
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    n, both = bit_statistics(nodes)
    links = _links(nodes.select("fp"), allocate(n, _agreement(n, both), tau), tau) if tau else None
    if links is None:
        named = nodes.select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    else:
        roots = _components(links)
        rooted = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
        lows = cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
        named = cut(rooted.join(lows, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_key")


# -- a given similarity -------------------------------------------------------------
#
# Texts that share 0.8 of their five-word shingles differ in about ten of the 64 bits of a
# fingerprint, too many to probe for. The prefix filter finds them without loss: put the
# shingles of every text in one order, rare ones first. Of two texts at a similarity t, the
# shorter's first n - ceil(2t / (1 + t) n) + 1 shingles and the longer's first
# n - ceil(t n) + 1 have one in common. A wide fingerprint of the set then sorts out what
# can't be that similar, so that only sets of likely pairs are exchanged and compared.

#: Longs of the wide fingerprint, and the sets from which on its bits follow the law of large numbers: smaller ones are compared.
WIDE, WIDE_FROM = 2, 50
#: Deviations that a pair at the very similarity may have more differing bits than expected: a miss in 10^8.
DEVIATIONS = 6

#: Longs of the signature of what a text has, or lacks, against another.
SIGNATURE = 4

#: Counters that the order of shingles is taken from. Any order finds all pairs, a good one makes few candidates.
COUNTERS, SLABS = 1 << 18, 16


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the text's different shingles; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    n = max(1, len(words) - shingle + 1)
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(shingle, max(1, len(words))) - 1 :].tolist(), strict=True)], np.uint64)
    return np.unique(hashes.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _rarity(made: DataFrame) -> np.ndarray:
    """How many rows hold a shingle of each counter. The table's size is fixed."""
    width = COUNTERS // SLABS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("hashes").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        held = [k for k in range(SLABS) if total[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in held], pa.binary())], ["slab", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"slab": group.column("slab")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.int64)
    schema = "slab int, counts binary"
    with small_batches(made.sparkSession):
        counted = made.select("hashes").mapInArrow(count, schema).groupBy("slab").applyInArrow(add, schema).collect()
    for k, counts in counted:
        out[k * width : (k + 1) * width] = np.frombuffer(counts, np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _prefixes(made: DataFrame, rarity: np.ndarray, t: float) -> DataFrame:
    """shingle, node, n, pos, short, score: the prefix of each row, ``pos`` its order; ``short`` are those within the shorter text's prefix.

    ``score`` is the mean logarithm of how many rows hold the row's shingles: high in the middle of a family of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, nodes, sizes, places, shorts, scores = [], [], [], [], [], []
            flat, offsets = batch.column("hashes").values.to_numpy(), batch.column("hashes").offsets.to_numpy()
            for node, a, b in zip(batch.column("node").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                h, n = flat[a:b], b - a
                first = n - math.ceil(t * n - 1e-9) + 1
                held = rarity[h & (COUNTERS - 1)]
                found.append(h[np.lexsort((h, held))[:first]])
                first = len(found[-1])
                nodes.append(np.full(first, node, np.int64))
                sizes.append(np.full(first, n, np.int32))
                places.append(np.arange(first, dtype=np.int32))
                shorts.append(places[-1] < n - math.ceil(2 * t / (1 + t) * n - 1e-9) + 1)
                scores.append(np.full(first, np.log(held).mean(), np.float32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, nodes, sizes, places, shorts, scores)], ["shingle", "node", "n", "pos", "short", "score"])

    return made.select("node", "hashes").mapInArrow(run, "shingle bigint, node bigint, n int, pos int, short boolean, score float")


_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)


def _wide(hashes: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """Majority of the bits of all hashes, each mixed in ``WIDE`` ways."""
    ones = np.zeros(BITS * WIDE, np.int64)
    for at in range(0, len(hashes), chunk):
        h = hashes[at : at + chunk].view(np.uint64)[:, None] * _ODD
        h ^= h >> np.uint64(32)
        h *= _ODD[::-1]
        ones += _ones(h ^ (h >> np.uint64(29)))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def _likely(n: Column, fp: Column, other_n: Column, other_fp: Column, similarity: float) -> Column:
    """Whether two sets can be that similar by their sizes and wide fingerprints."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = BITS * WIDE
    most = bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)) if p else 0
    apart = sum((F.bit_count(fp[k].bitwiseXOR(other_fp[k])) for k in range(WIDE)), F.lit(0))
    sizes = (n >= similarity * other_n - 1e-6) & (other_n >= similarity * n - 1e-6)
    return sizes & ((F.least(n, other_n) < WIDE_FROM) | (apart <= most))


def _within(nodes: DataFrame, tau: int = 2) -> DataFrame:
    """a, b: pairs of nodes that the generalised pigeonhole links by their SimHash fingerprints (the first long of ``fp``), written.

    Fingerprints within ``tau`` bits are linked as in ``near_duplicates``, by their least nodes; nodes of one fingerprint by its least.
    """
    held = cut(nodes.select("node", F.col("fp")[0].alias("fp")), "simhashes")
    lows = cut(held.groupBy("fp").agg(F.min("node").alias("low")), "lows")
    n, both = bit_statistics(lows)
    links = _links(lows.select("fp"), allocate(n, _agreement(n, both), tau), tau)
    ends = [lows.select(F.col("fp").alias(x), F.col("low").alias(f"{x}_low")) for x in "ab"]
    apart = links.join(ends[0], "a").join(ends[1], "b").select(F.col("b_low").alias("a"), F.col("a_low").alias("b"))
    same = held.join(lows, "fp").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return cut(apart.unionAll(same), "within")


def _only(rows: DataFrame, keys: DataFrame, key: str = "node") -> DataFrame:
    """The rows of those keys. Up to ``FEW`` keys are broadcast, so that other rows are not exchanged."""
    few = keys.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, x, y: the written pairs with the sets of both.

    Up to ``FEW`` pairs are broadcast to the sets of their first texts, so that a set is exchanged once for each
    pair that it begins, and once if it ends any: pairs should end in few different texts.
    """
    few = pairs.limit(FEW + 1).count() <= FEW
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(F.broadcast(pairs) if few else pairs, "a")
    ends = cut(pairs.select(F.col("b").alias("node")).distinct(), "ends")
    return first.join(_only(sets, ends).select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs a, b whose similarity over all shingles is reached, written."""
    shared = F.size(F.array_intersect("x", "y"))
    return cut(_with_sets(pairs, sets).where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b"), "linked")


def _signature(shingles: str) -> Column:
    """Bits of the shingles of an array column: what is in one signature and not in the other is in one array and not in the other."""
    own = "shiftright(h, 18)"  # other bits than those that the counters take
    bit = f"aggregate({shingles}, 0L, (s, h) -> s | if({own} & {SIGNATURE - 1} = k, shiftleft(1L, cast(shiftright({own}, 6) & 63 as int)), 0L))"
    return F.expr(f"transform(sequence(0, {SIGNATURE - 1}), k -> {bit})")


def _against_middle(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node, ref, common, more, less: each node against a text in the middle of its family, written.

    ``ref`` is the best-scored text that a bucket of the node holds; ``common`` counts the shingles of both, ``more`` and ``less``
    are signatures of those that only the node and only ``ref`` have.
    """
    best = rows.groupBy("shingle").agg(F.max(F.struct("score", "node")).alias("best"))
    refs = cut(rows.join(best, "shingle").groupBy("node").agg(F.max("best").getField("node").alias("ref")), "refs")
    both = _with_sets(refs.select(F.col("node").alias("a"), F.col("ref").alias("b")), sets)
    parts = both.select(F.col("a").alias("node"), F.col("b").alias("ref"), F.size("x").alias("n"), F.array_except("x", "y").alias("u"), F.array_except("y", "x").alias("v"))
    found = cut(parts.select("node", "ref", (F.col("n") - F.size("u")).alias("common"), _signature("u").alias("more"), _signature("v").alias("less")), "against")
    drop_written(refs)
    return found


def _most_shared() -> Column:
    """At most so many shingles have x and y in common, where both were set against the same text.

    Within that text each lacks what it lacks itself and what only the other lacks; outside it each has what it has and the
    other may have too. Signatures count the differences too low, never too high, so the bound holds.
    """

    def apart(a: str, b: str, part: str) -> Column:
        return sum((F.bit_count(F.col(f"{a}.{part}")[k].bitwiseAND(F.bitwise_not(F.col(f"{b}.{part}")[k]))) for k in range(SIGNATURE)), F.lit(0))

    inside = F.least(*[F.col(f"{a}.common") - apart(b, a, "less") for a, b in ("xy", "yx")])
    outside = F.least(*[F.col(f"{a}.n") - F.col(f"{a}.common") - apart(a, b, "more") for a, b in ("xy", "yx")])
    return inside + outside


def similar_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, root for every row: root names the group of texts linked at the similarity (Jaccard, shingles).

    First, the texts that the generalised pigeonhole links by their SimHash fingerprints are compared. Texts at the
    very similarity differ in more bits than it can probe for; these are found by prefixes: all pairs that can reach the
    similarity share a shingle of their prefixes, and those whose wide fingerprints are near (a bound that one of 10^8 such
    pairs misses) are compared. All shingles of both decide each time. Each text is compared with two leaders of each of
    its buckets, which joins large groups; then all pairs of a bucket that are not yet in one
    group, and share enough for all we know (their sizes, fingerprints, places of the shingle, and
    differences from a text in the middle of their family), are compared. Nulls, ties and empty tables as in ``near_duplicates``.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        for batch in (part for big in batches for part in portions(big)):
            sets = [_shingles(t, shingle) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes), _lists([_wide(x) for x in sets]), _lists(sets)], ["doc_id", "text_key", "node", "fp", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    # a node is a set of shingles: texts with the same set are one
    made = rows.mapInArrow(make, "doc_id bigint, text_key bigint, node bigint, fp array<bigint>, hashes array<bigint>")
    made = cut(made.withColumn("row", F.monotonically_increasing_id()), "shingles")
    entries = cut(_prefixes(made, _rarity(made), similarity), "prefixes")
    shared = cut(entries.groupBy("shingle").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.max("short").alias("s")).where("u != v and s").select("shingle"), "shared")
    buckets = _only(entries, shared, "shingle").distinct()
    fps = cut(made.groupBy("node").agg(F.min("fp").alias("fp")), "fps")
    held = cut(buckets.join(fps, "node"), "buckets")
    drop_written(entries)
    names = cut(made.select("doc_id", "text_key", "node", "row"), "names")
    # of equal sets that of the first row is kept; the sets themselves are not exchanged
    firsts = _only(names, cut(held.select("node").distinct(), "nodes")).groupBy("node").agg(F.min("row").alias("row"))
    sets = cut(_only(made.select("row", "node", "hashes"), cut(firsts.select("row"), "firsts"), "row").select("node", "hashes"), "sets")
    drop_written(made)

    # first what the pigeonhole finds: the nearest texts
    within = _within(fps)
    links = _linked(within, sets, similarity)
    roots = cut(_components(links), "roots")

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def least(x: str, y: str) -> Column:
        return similarity / (1 + similarity) * (F.col(f"{x}n") + F.col(f"{y}n")) - 1e-6

    def likely(x: str, y: str) -> Column:
        col = lambda name: (F.col(f"{x}{name}"), F.col(f"{y}{name}"))
        # what the two can have in common before, at and after this shingle
        most = F.least(*col("pos")) + F.least(*[n - pos for n, pos in zip(col("n"), col("pos"), strict=True)])
        return _likely(F.col(f"{x}n"), F.col(f"{x}fp"), F.col(f"{y}n"), F.col(f"{y}fp"), similarity) & (most >= least(x, y))

    # each bucket has two leaders for the texts of about one size: one from the middle of its family, which most of the
    # family is likely to be near, and one that is another than in the next bucket
    band = F.floor(F.log("n") / math.log(1 / similarity)) if similarity < 1 else F.col("n")
    banded = held.withColumn("band", band).withColumn("turn", F.xxhash64("shingle", "node"))
    leaders = banded.groupBy("shingle", "band").agg(F.max(F.struct("score", "node", "n", "pos", "fp")).alias("p"), F.min(F.struct("turn", "node", "n", "pos", "fp", "score")).alias("q"))
    led = banded.join(leaders, ["shingle", "band"]).select(F.struct("score", "node").alias("x"), *[F.when(likely("", f"{x}."), F.struct(f"{x}.score", f"{x}.node")).alias(x) for x in "pq"])
    # a pair ends in the text nearer to the middle, of which there are few
    stars = led.select("x", F.explode(F.array("p", "q")).alias("y")).where("x.node != y.node").select(F.least("x", "y").getField("node").alias("a"), F.greatest("x", "y").getField("node").alias("b")).distinct()
    for x in "ab":
        stars = stars.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    # those in one group need no other link
    stars = cut(stars.where("coalesce(a_root, a) != coalesce(b_root, b)").select("a", "b"), "stars")
    links = links.unionAll(_linked(stars, sets, similarity))
    roots = cut(_components(links), "roots")

    named = cut(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    shares = named.groupBy("shingle", "root").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("shingle").agg(F.max(F.struct("m", "root")).getField("root").alias("most"), F.count("*").alias("groups")).where("groups > 1").select("shingle", "most")
    rest = cut(named.join(mixed, "shingle"), "mixed")
    drop_written(held, fps, within, stars, named)
    x_first = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    near = F.when(x_first, F.col("x.short")).otherwise(F.col("y.short")) & likely("x.", "y.")
    near &= (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
    # buckets in which a text has no such partner at all are left out, so that few sets are looked into
    met_at = cut(rest.where("root != most").alias("x").join(rest.alias("y"), near, "left_semi").select("shingle").distinct(), "met_at")
    few = cut(_only(rest, met_at, "shingle"), "few")
    # no more can be shared than what two texts have in common with, and differ in from, the middle of their family
    against = _against_middle(few, sets)
    opened = cut(few.join(against, "node"), "against")
    drop_written(rest, few, against)
    x, y = opened.where("root != most").alias("x"), opened.alias("y")
    met = x.join(y, near & ((F.col("x.ref") != F.col("y.ref")) | (_most_shared() >= least("x.", "y."))))
    met = cut(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).select(*ordered).distinct(), "met")
    links = links.unionAll(_linked(met, sets, similarity))
    drop_written(opened, met, sets)
    roots = cut(_components(links), "roots")
    return names.join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, similarity: float | None = 0.8, tau: int = 2, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, all columns: that of the smallest id (nulls last), then the smallest text hash.

    Groups are those of ``similar_texts``, or with ``similarity`` None those of
    ``near_duplicates``. Repeated rows of the chosen one count as one.
    """
    names = fresh(docs, "__id", "__no_id", "__key")
    groups = similar_texts(docs, similarity, shingle, id_col, text_col) if similarity is not None else near_duplicates(docs, tau, shingle, id_col, text_col)
    found = groups.select("root", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key").alias("x"))
    best = found.groupBy("root").agg(F.min("x").alias("x")).select("x.doc_id", "x.text_key")
    values = [F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("text_key")]
    chosen = cut(best.select(*[v.alias(n) for v, n in zip(values, names, strict=True)]), "chosen")
    doc_id = F.col(id_col).cast("long")
    own = [F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), F.xxhash64(text_col)]
    return docs.withColumns(dict(zip(names, own, strict=True))).join(chosen, names).dropDuplicates(names).select(*docs.columns)


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), tau=2, shingle=3)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
