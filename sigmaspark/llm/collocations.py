"""Collocations of two to four words from sorted count streams.

Every word opens a window of up to four words inside its piece. Tasks sort their windows,
count equal ones and cut the run at common splitters; a reducer merges the runs of its
range, which gives the counts of all prefixes of a window too, so one exchange counts
phrases of every order. The frequent ones are kept as two streams, in prefix order (words
from the left) and in suffix order (words from the right). A walk through the first meets
a phrase's left parts before the phrase and its right extensions after it, a walk through
the second its right parts and its left extensions; a merge join of both has all counts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

ORDER = 4
SPACE, BREAK = 32, 10
PIECE_ENDS = b".,;:!?\n\v\f\r"
#: Bytes of text of a sorted run, and about so many of a reducer.
RUN_BYTES, REDUCER_BYTES = 8_000_000, 12_000_000
#: Bytes of text from which splitters are drawn, and windows drawn for each splitter.
SAMPLE_BYTES, DRAWN = 64_000_000, 64
#: Rows of a range of the streams of frequent phrases.
STREAM_ROWS = 100_000
SCALE = 2_000_000

_table = bytearray(range(256))
for _c in range(65, 91):
    _table[_c] = _c + 32
for _c in PIECE_ENDS:
    _table[_c] = BREAK
_table[9] = SPACE
_PLAIN = bytes(_table)


# -- windows of words ---------------------------------------------------------------

def _windows(texts: list[bytes], langs: list[bytes]) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Languages and words in byte order, and a row (lang, w1, .., w4) for each word: numbers from 1, 0 beyond the piece."""
    names = sorted(set(langs))
    data = np.frombuffer(b"\n".join(texts).translate(_PLAIN), np.uint8)
    gap = (data == SPACE) | (data == BREAK)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return names, [], np.zeros((0, ORDER + 1), np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    w = rank[found.indices.to_numpy()]
    piece = np.cumsum(data == BREAK, dtype=np.int32)[starts]
    out = np.zeros((len(w), ORDER + 1), np.int32)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    place = {x: k for k, x in enumerate(names)}
    out[:, 0] = np.array([place[x] for x in langs], np.int32)[np.searchsorted(begins, starts, "right") - 1]
    out[:, 1] = w
    for k in range(1, ORDER):
        out[:-k, k + 1] = np.where(piece[k:] == piece[:-k], w[k:], 0)
    return names, found.dictionary.take(pa.array(order)).to_pylist(), out


def _counted(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, each once, with the sum of its counts."""
    two = lambda a, b: rows[:, a].astype(np.int64) << 32 | rows[:, b]
    rows = rows[order := np.lexsort((rows[:, 4], two(2, 3), two(0, 1)))]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    if counts is None:
        return rows[first], np.diff(np.concatenate([first, [len(rows)]]))
    return rows[first], np.add.reduceat(counts[order], first)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts and languages of about ``RUN_BYTES``; longer texts are cut where a piece ends."""
    texts: list[bytes] = []
    langs: list[bytes] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, rest = lang.as_py().encode(), text.as_py().encode()
            while rest:
                if len(rest) > RUN_BYTES:
                    plain = rest[:RUN_BYTES].translate(_PLAIN)
                    at = plain.rfind(b"\n") + 1 or rest.translate(_PLAIN).find(b"\n") + 1 or len(rest)
                else:
                    at = len(rest)
                texts.append(rest[:at])
                langs.append(lang)
                rest = rest[at:]
                size += at
                if size >= RUN_BYTES:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _packed(names: list[bytes], words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: its words once, then numbers by column and byte, compressed."""
    used, numbers = np.unique(rows[:, 1:], return_inverse=True)
    if used[0] > 0:
        used, numbers = np.concatenate([[0], used]), numbers + 1
    columns = np.concatenate([rows[:, :1].T, numbers.reshape(-1, ORDER).T, counts[None, :]]).astype("<u4")
    columns[1, 1:] = np.diff(columns[1].astype("<i8")).astype("<u4")
    planes = columns.reshape(-1, 1).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    held = [b"\n".join(names), b"\n".join(words[k - 1] for k in used[1:].tolist()), planes.tobytes()]
    head = np.array([len(rows), *map(len, held)], "<i8").tobytes()
    body = b"".join(held)
    return head + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(block[:32], "<i8").tolist()
    body = pa.decompress(block[32:], decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    a, b = sizes[0], sizes[0] + sizes[1]
    planes = np.frombuffer(body[b:], np.uint8).reshape(-1, 4, n).transpose(0, 2, 1)
    columns = np.ascontiguousarray(planes).view("<u4").reshape(-1, n).copy()
    columns[1] = np.cumsum(columns[1].astype(np.uint32), dtype=np.uint32)
    return body[:a].split(b"\n"), body[a:b].split(b"\n") if b > a else [], columns[:-1].T.astype(np.int32), columns[-1].astype(np.int64)


def _row_key(names: list[bytes], words: list[bytes], row: np.ndarray) -> tuple[bytes, ...]:
    return (names[row[0]], *[words[k - 1] for k in row[1:].tolist() if k])


def _merge(blocks: list[bytes], least: int) -> Iterator[tuple[bytes, list[bytes], int]]:
    """(lang, words, count) of the phrases of a reducer's range, () for all words of a language.

    Those below ``least`` are left out, except the first and the last of each order: their
    other windows may lie in a neighbour's range.
    """
    runs = [_unpacked(b) for b in blocks]
    names = sorted({x for r in runs for x in r[0]})
    words = sorted({x for r in runs for x in r[1]})
    name_at, word_at = {x: k for k, x in enumerate(names)}, {x: k + 1 for k, x in enumerate(words)}
    for own_names, own_words, rows, _ in runs:
        rows[:, 0] = np.array([name_at[x] for x in own_names], np.int32)[rows[:, 0]]
        rows[:, 1:] = np.array([0, *[word_at[x] for x in own_words]], np.int32)[rows[:, 1:]]
    rows, counts = _counted(np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs]))
    new = np.zeros(len(rows), bool)
    new[0] = True
    for order in range(ORDER + 1):
        new[1:] |= rows[1:, order] != rows[:-1, order]
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts, first)
        keep = total >= least
        keep[[0, -1]] = True
        if order == 0:
            keep[:] = True
        else:
            keep &= rows[first, order] > 0
        for at, n in zip(first[keep].tolist(), total[keep].tolist(), strict=True):
            yield names[rows[at, 0]], [words[k - 1] for k in rows[at, 1 : order + 1].tolist()], n


# -- frequent phrases ---------------------------------------------------------------

_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])


def _sampled_splitters(docs: DataFrame, total: int, parts: int) -> list[tuple[bytes, ...]]:
    """Windows that cut all windows into ``parts`` ranges of about equal size, from a sample of the documents."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    rate = min(1.0, DRAWN * parts / max(1.0, share * total / 8))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _runs(batches):
            names, words, rows = _windows(texts, langs)
            picked = rows[np.random.default_rng(len(rows)).random(len(rows)) < rate]
            if len(picked):
                yield pa.RecordBatch.from_arrays([pa.array([[x.decode() for x in _row_key(names, words, r)] for r in picked], pa.list_(pa.string()))], ["key"])

    sample = docs if share == 1.0 else docs.sample(share, 7)
    keys = sorted(tuple(x.encode() for x in r.key) for r in sample.mapInArrow(draw, "key array<string>").collect())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def phrase_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, f: exact counts of phrases of one to four words that occur ``least`` times or more, no words for all of a language.

    Null texts are empty, a null language is ``und``. The driver holds splitters only.
    """
    own = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    splitters = _sampled_splitters(own, total, max(1, math.ceil(total / REDUCER_BYTES)))
    parts = len(splitters) + 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _runs(batches):
            names, words, rows = _windows(texts, langs)
            if not len(rows):
                continue
            rows, counts = _counted(rows)
            at = [0, *[bisect_right(range(len(rows)), s, key=lambda k: _row_key(names, words, rows[k])) for s in splitters], len(rows)]
            held = [(k, _packed(names, words, rows[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())], ["part", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(k, []).append(b)
        for own_blocks in blocks.values():
            out: list[tuple] = []
            for lang_, words, n in _merge(own_blocks, least):
                out.append((lang_.decode(), [w.decode() for w in words], n))
                if len(out) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTS, strict=True)], schema=_COUNTS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    merged = own.mapInArrow(runs, "part int, block binary").repartitionById(parts, "part").mapInArrow(merge, "lang string, words array<string>, f long")
    return merged.groupBy("lang", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.size("words") == 0))


# -- streams of frequent phrases ----------------------------------------------------

def _walk(counts: DataFrame, n: int, backwards: bool) -> DataFrame:
    """lang, phrase, parts, extension: counts of a phrase's first words (last ones if ``backwards``), most frequent longer phrase.

    Phrases are dealt to ranges of the order and walked through with a stack. A phrase
    whose extensions reach into later ranges goes to these too.
    """
    ranges = max(1, math.ceil(n / STREAM_ROWS))
    turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
    keys = sorted((r.lang, *turn(r.words)) for r in counts.select("lang", "words").sample(min(1.0, DRAWN * ranges / max(n, 1)), 11).collect()) if ranges > 1 else []
    splitters = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, out = [], []
            for lang, words, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = turn(words)
                key = (lang, *words)
                home = bisect_right(splitters, key)
                for k in range(home, bisect_right(splitters, (*key, chr(0x10FFFF))) + 1):
                    part.append(k)
                    out.append((lang, words, f, k == home))
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()), strict=True)]], ["part", "lang", "words", "f", "home"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # lang, words, f, home, extension
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(stack) > depth:
                lang, words, f, home, extension = stack.pop()
                if len(words) > 1:
                    out.append((lang, " ".join(turn(words)), f, [s[2] for s in stack] if home else None, extension))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], ["lang", "phrase", "f", "parts", "extension"])

        for batch in batches:
            for lang, words, f, home in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "f", "home")), strict=True):
                if stack and (stack[0][0] != lang or stack[0][1] != words[:1]):
                    close(0)
                while stack and stack[-1][1] != words[: len(stack[-1][1])]:
                    close(len(stack) - 1)
                if stack and len(words) == len(stack[-1][1]) + 1:
                    stack[-1][4] = max(stack[-1][4], f)
                stack.append([lang, words, f, home, 0])
            if out:
                yield rows()
                out.clear()
        close(0)
        if out:
            yield rows()

    dealt = counts.where(F.size("words") > 0).mapInArrow(deal, "part int, lang string, words array<string>, f long, home boolean").repartitionById(len(splitters) + 1, "part").sortWithinPartitions("lang", "words")
    walked = dealt.mapInArrow(walk, "lang string, phrase string, f long, parts array<long>, extension long")
    side = "right" if backwards else "left"
    return walked.groupBy("lang", "phrase").agg(F.max("f").alias("f"), F.max("parts").alias(f"{side}_parts"), F.max("extension").alias(f"{side}_extension"))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best ``most`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of the two parts of its worst cut, score is
    2 000 000 * a / (l + r), rounded down. Phrases inside a longer frequent one that has
    ``covered`` per cent of their count are left out: one word more is enough to look at,
    as every longer one holds such a phrase that is at least as frequent. Null and empty
    texts have no words, repeated rows count again, ties go by count and phrase; other
    columns are ignored; an empty table has no phrases.
    """
    counts = cut(phrase_counts(docs, least, text, lang), "counts")
    n = counts.count()
    left, right = _walk(counts, n, False), _walk(counts, n, True).drop("f")
    both = left.hint("merge").join(right.hint("merge"), ["lang", "phrase"])
    wide = lambda c: c.cast("decimal(20,0)")
    # left_parts[k] has k + 1 words, the rest has as many as are left
    cuts = F.transform("left_parts", lambda l, k: F.struct(l.alias("l"), F.element_at("right_parts", -(k + 1)).alias("r"), (k + 1).alias("k")))  # noqa: E741
    # the scale makes products of more than 64 bits, which decimals hold
    worst = F.array_min(F.transform(cuts, lambda c: F.struct(F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide(F.col("f")), wide(c["l"]) + wide(c["r"])).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    kept = both.where(F.lit(100).cast("decimal(3,0)") * wide(F.greatest("left_extension", "right_extension")) < F.lit(covered).cast("decimal(3,0)") * wide(F.col("f"))).withColumn("w", worst)
    scored = kept.select("lang", "phrase", F.col("f").alias("a"), F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    words = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
