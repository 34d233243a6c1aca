"""Repeated strings of some length by a distributed sort of suffixes.

Of all suffixes those at anchors are sorted: an anchor is the least hash of the short
strings inside a window, so equal windows hold equal anchors at equal places. Anchors that
no other place has (a count of hashes, which may only keep too many) can't lie in a repeat.
The others are sorted twice: by the text that follows, then the text before read backwards,
and the other way round. Tasks sort runs and write them front-coded, each string without
the prefix that it shares with the one before, cut at common splitters; a reducer merges
its runs by a loser tree that keeps common prefixes and compares what lies beyond them only.

Neighbours in the first order have the longest common text to the right, in the second to
the left. Windows that a neighbour shares are repeated; windows beyond the longest text on
either side are not. The few between both are sorted as whole windows, against all anchors
of the same short string.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_written, portions, shared_dir, table

LENGTH, GRAM = 200, 40
#: Bytes of strings in a sorted run and, about, of a reducer; strings drawn for each splitter; starts of windows hashed at a time.
RUN_BYTES, REDUCER_BYTES, DRAWN, BLOCK = 24_000_000, 32_000_000, 16, 4_000_000
#: Ends the first half of a string: no byte of UTF-8.
END = b"\xff"
RIGHT, LEFT, WHOLE = b"R", b"L", b"W"
_PLACE = (1 << 24) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


# -- anchors ------------------------------------------------------------------------

def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``GRAM`` = 32 + 8 bytes, by doubling."""
    h, n = _BYTE[data], 1
    for k in range(5):
        eight = h if n <= 8 else eight
        h = h[:-n] * _ODD[k] + h[n:]
        n *= 2
    h = h[: len(h) - 8] * _ODD[5] + eight[32:]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, span: int) -> np.ndarray:
    size, cur = 1, v
    while size * 2 <= span:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    n = len(v) - span + 1
    return np.minimum(cur[:n], cur[span - size : span - size + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor: number of its text, hash, and place << 16 | most << 8 | least.

    The windows of which it is the first least hash begin ``least`` to ``most`` bytes before it.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        h = _grams(data[at : at + BLOCK + LENGTH - 1])
        least = _least((h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        first = np.maximum(starts, at) - at
        n = np.clip(np.minimum(starts + sizes - LENGTH + 1, at + len(least)) - at - first, 0, None)
        own = np.flatnonzero(n)
        begin = np.repeat(first[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())
        if not len(begin):
            continue
        m = (least[begin] & np.uint64(_PLACE)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        p, lo, hi = m[new], begin[new], begin[np.concatenate([new[1:], [len(m)]]) - 1]
        text = np.searchsorted(starts, p + at, "right") - 1
        out.append((text, h[p].view(np.int64), (p + at - starts[text]) << 16 | (p - lo) << 8 | (p - hi)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# -- sorted runs --------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8 if differ else n


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths of the prefixes that sorted strings share with the one before, and the rest of each."""
    shared = [0, *map(common_prefix, strings, strings[1:])] if strings else []
    return shared, [s[n:] for s, n in zip(strings, shared, strict=True)]


def _packed(strings: list[bytes], ghost: list[bool], places: list[list[tuple[bytes, int, bool]]]) -> bytes:
    shared, rest = front_coded(strings)
    keys = {k: n for n, k in enumerate(dict.fromkeys(p[0] for own in places for p in own))}
    flat = [p for own in places for p in own]
    held = [
        np.array(shared, "<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes(), np.array(ghost, "?").tobytes(), np.array([len(own) for own in places], "<u4").tobytes(), b"".join(rest),
        np.array([keys[k] for k, _, _ in flat], "<u4").tobytes(), np.array([x for _, x, _ in flat], "<i8").tobytes(), np.array([x for _, _, x in flat], "?").tobytes(), b"".join(keys),
    ]
    return np.array([len(held), *map(len, held)], "<i8").tobytes() + pa.compress(b"".join(held), codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> Iterator[tuple[int, bytes, bool, list[tuple[bytes, int, bool]]]]:
    """Prefix shared with the string before, string, whether it belongs to a neighbour, and its places."""
    count = int(np.frombuffer(block[:8], "<i8")[0])
    sizes = np.frombuffer(block[8 : 8 + 8 * count], "<i8")
    body = pa.decompress(block[8 + 8 * count :], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    part = [body[e - s : e] for s, e in zip(sizes.tolist(), ends, strict=True)]
    shared, lengths, ghost, counts = (np.frombuffer(p, t).tolist() for p, t in zip(part, ("<u2", "<u2", "?", "<u4"), strict=False))
    rest, key, at, many = part[4], np.frombuffer(part[5], "<u4").tolist(), np.frombuffer(part[6], "<i8").tolist(), np.frombuffer(part[7], "?").tolist()
    s, i, j = b"", 0, 0
    for n, size, g, c in zip(shared, lengths, ghost, counts, strict=True):
        s = s[:n] + rest[i : i + size]
        i += size
        yield n, s, g, [(part[8][16 * key[x] : 16 * key[x] + 16], at[x], many[x]) for x in range(j, j + c)]
        j += c


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple]]:
    """All items (.., string, ..) of sorted runs in order, each with the prefix that it shares with the one before.

    A loser tree: every loser knows the prefix that it shares with the winner it met. The
    longer of two such prefixes wins without a look at the strings; equal ones are compared
    from their end on. Items begin with the prefix shared with the item before in their run.
    """
    n = len(runs)
    if not n:
        return
    heads: list[tuple | None] = [next(r, None) for r in runs]
    known = [0] * n
    tree = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x[1], y[1]
        k = common_prefix(s, t, known[a])
        if s[k : k + 1] <= t[k : k + 1]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        won, tree[node] = play(build(2 * node), build(2 * node + 1))
        return won

    best = build(1) if n > 1 else 0
    while (item := heads[best]) is not None:
        yield known[best], item
        heads[best] = follower = next(runs[best], None)
        if follower is not None:
            known[best] = follower[0]
        node = (best + n) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


_RUNS = "part int, block binary"
_PLACED = "key binary, at long, found long"


def _sorted_runs(batches: Iterator[pa.RecordBatch], strings_of, splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Front-coded parts of runs; a part also has its run's neighbours beyond its ends, as ghosts."""
    held: dict[bytes, list[tuple[bytes, int, bool]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        strings = sorted(held)
        at = [0, *[bisect_left(strings, s) for s in splitters], len(strings)]
        blocks = []
        for a, b in zip(at, at[1:], strict=False):
            lo, hi = max(0, a - 1), min(len(strings), b + 1)
            own = [a <= k < b for k in range(lo, hi)]
            blocks.append(_packed(strings[lo:hi], [not x for x in own], [held[strings[k]] if x else [] for k, x in zip(range(lo, hi), own, strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    for batch in batches:
        for key, at, many, string in strings_of(batch):
            places = held.setdefault(string, [])
            if not places:
                size += len(string) + 100
            places.append((key, at, many))
            size += 100
            if size >= 4 * RUN_BYTES:
                yield flush()
                held.clear()
                size = 0
    if held:
        yield flush()


def _merge_sorted(rows: DataFrame, strings_of, splitters: list[bytes], decide) -> DataFrame:
    """key, at, found of the places for which ``decide`` (string before, string, string after, their prefixes, whether it repeats) gives a number."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sorted_runs(batches, strings_of, splitters)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(k, []).append(b)
        out: list[tuple] = []

        def settle(before, it, shared, after, next_shared) -> None:
            string, places = it
            if places and (found := decide(before, string, after, shared, next_shared, len(places) > 1 or places[0][2])) is not None:
                out.extend((k, at, found) for k, at, _ in places)

        for own in blocks.values():
            before, now, shared = b"", None, 0
            for n, (_, string, ghost, places) in merged([_unpacked(b) for b in own]):
                if now is not None and n == len(string) == len(now[0]):
                    now[1].extend(places)
                    continue
                if now is not None:
                    settle(before, now, shared, string, n)
                    before = now[0]
                now, shared = (string, places), n
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "at", "found"])
                    out.clear()
            if now is not None:
                settle(before, now, shared, b"", 0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "at", "found"])

    parts = len(splitters) + 1
    return rows.mapInArrow(runs, _RUNS).repartitionById(parts, "part").mapInArrow(merge, _PLACED)


def _splitters(rows: DataFrame, strings_of, strings: int, size: int) -> list[bytes]:
    """Strings that cut all into ranges of about ``REDUCER_BYTES``, from a sample of the texts."""
    parts = math.ceil(strings * size / REDUCER_BYTES)
    if parts < 2:
        return []
    share = min(1.0, 8 * DRAWN * parts / strings)
    rate = min(1.0, DRAWN * parts / (share * strings))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        for batch in batches:
            picked = [s for *_, s in strings_of(batch) if rng.random() < rate]
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.binary())], ["s"])

    keys = sorted(bytes(r.s) for r in (rows if share == 1.0 else rows.sample(share, 3)).mapInArrow(draw, "s binary").collect())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


# -- strings at anchors and what they decide ------------------------------------------

def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, bool, list]]:
    for part in portions(batch):
        for key, text, copies, ats in zip(*(part.column(c).to_pylist() for c in ("key", "text", "copies", "ats")), strict=True):
            yield key, text.encode(), copies > 1, ats


def _both_orders(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bool, bytes]]:
    for key, text, many, ats in _texts(batch):
        for at in ats:
            p, most, least = at >> 16, at >> 8 & 255, at & 255
            right, left = text[p : p - least + LENGTH], text[p - most : p][::-1]
            yield key, at, many, RIGHT + right + END + left
            yield key, at, many, LEFT + left + END + right


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bool, bytes]]:
    """Whole windows; ``at`` of a result is the place where one begins."""
    for key, text, many, ats in _texts(batch):
        for x in ats:
            p, most, least = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
            for d in x["far"]:
                if least <= d <= most:
                    yield key, p - d, many, WHOLE + text[p - d : p - d + LENGTH]


def _neighbours(before: bytes, string: bytes, after: bytes, shared: int, next_shared: int, repeats: bool) -> int | None:
    """Bits of 8: order, bound, and up to two intervals of window starts (first, last + 1), counted back from the anchor.

    The bound is the longest text that any other anchor shares on the side of the order.
    """
    tag, cut_at = string[:1], string.index(END)
    first, second = cut_at - 1, len(string) - cut_at - 1
    right, left = (first, second) if tag == RIGHT else (second, first)
    least, most = LENGTH - right, left
    side, found, bound = int(tag == LEFT), [], 0
    if repeats:
        found, bound = [(least, most + 1)], first
    else:
        for other, n in ((before, shared), (after, next_shared)):
            if n < 1:
                continue
            if n > cut_at:
                a, b = first, n - cut_at - 1
            else:
                a = n - 1
                b = None
            bound = max(bound, a)
            if (a + second if b is None else a + b) < LENGTH:
                continue
            if b is None:
                b = common_prefix(string[cut_at + 1 :], other[other.index(END) + 1 :])
            r, l = (a, b) if tag == RIGHT else (b, a)  # noqa: E741
            lo, hi = max(LENGTH - r, least), min(l, most) + 1
            if lo < hi:
                found.append((lo, hi))
    if bound < (LENGTH - most if tag == RIGHT else least):
        return None
    found += [(0, 0)] * (2 - len(found))
    return side << 40 | bound << 32 | found[0][0] << 24 | found[0][1] << 16 | found[1][0] << 8 | found[1][1]


def settled(row: np.ndarray, at: np.ndarray, found: np.ndarray, chunk: int = 50_000) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(row, start, end) of ranges that repeat for sure, (row, at, far) of the windows that remain open, from what both orders found."""
    order = np.lexsort((found, at, row))
    row, at, found = row[order], at[order], found[order]
    # an anchor that one order left out has no window that repeats; the two halves follow each other
    pair = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] == at[:-1]) & (found[1:] >> 40 == 1) & (found[:-1] >> 40 == 0))
    spans, left = [np.zeros((3, 0), np.int64)], [np.zeros((3, 0), np.int64)]
    far = np.arange(LENGTH - GRAM + 2)
    for k in range(0, len(pair), chunk):
        i = pair[k : k + chunk]
        own, place, most, least = row[i], at[i] >> 16, at[i] >> 8 & 255, at[i] & 255
        sure = np.zeros((len(i), len(far)), bool)
        for x in (found[i], found[i + 1]):
            for shift in (16, 0):
                sure |= (far >= (x >> shift + 8 & 255)[:, None]) & (far < (x >> shift & 255)[:, None])
        low, high = np.maximum(least, LENGTH - (found[i] >> 32 & 255)), np.minimum(most, found[i + 1] >> 32 & 255)
        n, d = np.nonzero((far >= low[:, None]) & (far <= high[:, None]) & ~sure)
        left.append(np.array([own[n], at[i][n], d]))
        edge = np.diff(np.pad(sure, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (n, first), (_, after) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        spans.append(np.array([own[n], place[n] - after + 1, place[n] - first + LENGTH]))
    return tuple(np.concatenate(spans, axis=1)), tuple(np.concatenate(left, axis=1))


def _lists(row: np.ndarray, n: int, **columns: np.ndarray) -> pa.Array:
    """Lists of structs for rows 0 to ``n`` - 1, from values whose rows ascend."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns)))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# -- the operator ---------------------------------------------------------------------

def content_key(text) -> object:
    """Half of the SHA-256 of a text; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _repeated_anchors(texts: DataFrame) -> DataFrame:
    """key, hash, at of the anchors whose short string occurs twice or more, or in a text that does."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                text, h, at = anchors([t.encode() for t in batch.column("text").to_pylist()])
                chosen = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(chosen), batch.column("copies").take(chosen), pa.array(h), pa.array(at)], ["key", "copies", "hash", "at"])

    return texts.select("key", "text", "copies").where(F.octet_length("text") >= LENGTH).mapInArrow(find, "key binary, copies long, hash long, at long")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, n_bytes, spans (start, end) and kept (bytes) of every different text: without the bytes that a repeated string of 200 covers.

    A string repeats if it begins at any other place, in the same text too; texts that occur
    more than once repeat as a whole. ``key`` is ``content_key`` of the text, by which rows
    join back; null texts are empty, texts under 200 bytes keep all bytes, repeated rows
    count as copies, other columns are ignored, an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    own = docs.select(content_key(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    one = own.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    one.write.bucketBy(buckets, "key").option("path", f"{shared_dir(spark)}/texts").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    found = cut(_repeated_anchors(texts), "anchors")
    # written, so that the join deals it out itself and can split a hash that many anchors have
    twice = cut(found.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash"), "twice")
    wanted = cut(found.join(twice, "hash", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("ats")), "wanted")
    count = wanted.agg(F.coalesce(F.sum(F.size("ats")), F.lit(0))).first()[0]
    met = texts.join(wanted, "key")
    placed = _merge_sorted(met, _both_orders, _splitters(met, _both_orders, 2 * count, 300), _neighbours)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("found"), batch.num_rows
            row = np.repeat(np.arange(n), np.diff(found.offsets.to_numpy()))
            at, value = (found.flatten().field(c).to_numpy() for c in ("at", "found"))
            (r, a, b), (r2, at2, far) = settled(row, at, value)
            order = np.lexsort((a, r))
            r, a, b = r[order], a[order], b[order]
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(r, n, start=a, end=b), _lists(r2, n, at=at2, far=far)], ["key", "spans", "open"])

    first = cut(placed.groupBy("key").agg(F.collect_list(F.struct("at", "found")).alias("found")).mapInArrow(settle, "key binary, spans array<struct<start:long,end:long>>, open array<struct<at:long,far:long>>"), "settled")
    spans = first.select("key", F.explode("spans").alias("s"))
    open_ = first.select("key", F.explode("open").alias("o")).select("key", "o.*")
    if not open_.isEmpty():
        asked = open_.join(found, ["key", "at"]).groupBy("hash").agg(F.sort_array(F.collect_set("far")).alias("far"))
        others = cut(found.join(asked, "hash").groupBy("key").agg(F.collect_list(F.struct("at", "far")).alias("ats")), "others")
        windows = others.agg(F.sum(F.aggregate("ats", F.lit(0).cast("long"), lambda s, x: s + F.size(x["far"])))).first()[0]
        met = texts.join(others, "key")
        more = _merge_sorted(met, _windows, _splitters(met, _windows, windows, LENGTH), lambda a, s, b, m, n, repeats: 0 if repeats else None)
        spans = spans.unionByName(more.select("key", F.struct(F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")).alias("s")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                sizes, removed, kept = [], [], []
                for t, own in zip(batch.column("text").to_pylist(), batch.column("all").to_pylist(), strict=True):
                    data, union = t.encode(), _union([(s["start"], s["end"]) for s in own or []])
                    sizes.append(len(data))
                    removed.append([{"start": a, "end": b} for a, b in union])
                    kept.append(b"".join(data[a:b] for (_, a), (b, _) in zip([(0, 0), *union], [*union, (len(data), 0)], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    gathered = texts.join(spans.groupBy("key").agg(F.collect_list("s").alias("all")), "key", "left").select("key", "text", "all")
    out = cut(gathered.mapInArrow(keep, "key binary, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"), "kept")
    spark.sql(f"DROP TABLE {name}")
    drop_written(found, twice, wanted, first)
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = pa.list_(_SPAN)


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = repeated_spans(docs).select("key", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", content_key(F.col("text")).alias("key")).join(out, "key").drop("key")
