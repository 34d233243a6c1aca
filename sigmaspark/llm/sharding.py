"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: 32 bits of a hash of the text, so that equal texts lie
together, then 32 bits that differ from row to row. Exact bytes and rows are counted
between candidate boundaries (key prefixes). An interval that a splitter falls into is
divided further, down to single text hashes, until the splitters meet the tolerance; one
that holds many rows is divided down to the rows. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, fresh, table

FIRST_BITS, STEP_BITS, TEXT_BITS, KEY_BITS = 12, 5, 32, 64
#: An interval with more rows is divided: its rows are sorted in one task.
LEAF_ROWS = 500_000


def sort_key(text: Column, row: Column) -> Column:
    """Unsigned order of the key as a signed long: equal texts share the upper half, the lower spreads rows."""
    upper = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row), 32))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits < KEY_BITS else key


def _deeper(bits: int) -> int:
    """The next length of prefixes: some bits more, but never past the text's half in one step."""
    return min(bits + STEP_BITS, TEXT_BITS if bits < TEXT_BITS else KEY_BITS)


def _leaf(first: int, refined: list[tuple[int, list[int]]]) -> Column:
    """The interval of a row as its first key: the deepest prefix below those that were divided."""
    levels = [first, *[_deeper(bits) for bits, _ in refined]]
    at = [F.shiftleft(_prefix(F.col("key"), b), KEY_BITS - b) if b < KEY_BITS else F.col("key") for b in levels]
    out = at[-1]
    for (bits, divided), start in reversed(list(zip(refined, at[:-1], strict=True))):
        out = F.when(_prefix(F.col("key"), bits).isin(divided), out).otherwise(start)
    return out


def _unsigned(x: int) -> int:
    return x & (2**64 - 1)


def histogram(keys: DataFrame, n_shards: int, tolerance: float, hot_share: float = 1 / 512) -> tuple[list[tuple[int, int, int]], int, list[tuple[int, list[int]]]]:
    """Intervals (first key, bytes, rows) in key order, fine enough for all splitters; the bits of the first candidates; and the prefixes divided.

    ``keys`` has key and size. Each interval is a row on the driver: at most 4096 to a
    million first ones, by the number of rows, and 32 for each interval divided because of a
    splitter or of ``hot_share`` or ``LEAF_ROWS``.
    """
    def counted(rows: DataFrame, bits: int) -> dict[int, tuple[int, int]]:
        got = rows.groupBy(_prefix(F.col("key"), bits).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        return {_unsigned(r.p) << (KEY_BITS - bits): (r.b, r.n) for r in got}

    first = min(20, max(FIRST_BITS, (2 * keys.count() // LEAF_ROWS).bit_length()))
    bits, found, refined = first, counted(keys, first), []
    fresh = set(found)
    total, rows = sum(b for b, _ in found.values()), sum(n for _, n in found.values())
    while fresh and bits < KEY_BITS:
        below, divided = 0, []
        for start in sorted(found):
            b, n = found[start]
            near = range(int(below * n_shards / total), min(n_shards, int((below + b) * n_shards / total) + 2)) if start in fresh else []
            cuts = [j * total / n_shards for j in near if below < j * total / n_shards < below + b]
            off = max((min(c - below, below + b - c) for c in cuts), default=0)
            if start in fresh and n > 1 and (bits < TEXT_BITS and off > tolerance * total / n_shards or n > min(LEAF_ROWS, max(1, hot_share * rows))):
                divided.append(start)
            below += b
        if not divided:
            break
        prefixes = [x >> (KEY_BITS - bits) for x in divided]
        signed = [p - 2**64 if p >= 2**63 else p for p in prefixes]
        refined.append((bits, signed))
        inner = keys.where(_prefix(F.col("key"), bits).isin(signed))
        bits = _deeper(bits)
        parts = counted(inner, bits)
        for start in divided:
            del found[start]
        found |= parts
        fresh = set(parts)
    return [(x - 2**64 if x >= 2**63 else x, *found[x]) for x in sorted(found)], first, refined


def shard_documents(docs: DataFrame, n_shards: int, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot for every row of ``docs``; shards of near-equal bytes.

    ``size`` is the text's UTF-8 bytes plus 16. Equal texts lie in one shard, whatever the
    size of their group; a splitter is off by at most the tolerance (a share of a shard) or
    half of the group of equal texts it falls into. Null texts are empty texts, null ids
    values like any other, repeated rows are rows of their own. Other columns are not read.
    An empty table gives an empty result.
    """
    return _placed(docs, n_shards, tolerance, id_col, text_col, []).drop("row")


def _placed(docs: DataFrame, n_shards: int, tolerance: float, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """``shard_documents`` with the number of each row and the named other columns."""
    spark = docs.sparkSession
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    wanted = [doc_id.alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), text.alias("text"), F.monotonically_increasing_id().alias("row")]
    inside = [F.struct(*[F.col(c) for c in others]).alias("own")] * bool(others)
    rows = docs.select(*wanted, *inside)
    # written once: the number of a row is fixed from here on
    keys = cut(rows.select("doc_id", "size", "text_crc32", "row", sort_key(F.col("text"), F.col("row")).alias("key"), *(["own"] * bool(others))), "keys")
    intervals, first, refined = histogram(keys.select("key", "size"), n_shards, tolerance)

    # intervals of one text hash go together: to the shard whose share their middle falls into
    groups: dict[int, int] = {}
    for start, size, _ in intervals:
        groups[start >> TEXT_BITS] = groups.get(start >> TEXT_BITS, 0) + size
    total, below, base, rows_before, shard, group = sum(groups.values()), 0, [], 0, 0, None
    for start, _, n in intervals:
        if start >> TEXT_BITS != group:
            group = start >> TEXT_BITS
            own = max(shard, min(n_shards - 1, int((below + groups[group] / 2) * n_shards / max(total, 1))))
            rows_before = rows_before if own == shard else 0
            shard, below = own, below + groups[group]
        base.append((start, shard, rows_before))
        rows_before += n
    starts = spark.createDataFrame(base, "leaf bigint, shard int, base bigint")
    order = Window.partitionBy("leaf").orderBy("key", "row")
    placed = keys.withColumn("leaf", _leaf(first, refined)).withColumn("at", F.row_number().over(order))
    # the table of intervals is bounded (see histogram)
    return placed.join(F.broadcast(starts), "leaf").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("base") + F.col("at") - 1).alias("slot"), "row", *(["own"] * bool(others)))


def write_shards(docs: DataFrame, path: str, n_shards: int, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``docs`` as Parquet, one folder per shard, in key order within its files.

    Nulls and repeated rows as in ``shard_documents``; a column named shard keeps its name,
    the shard's is then lengthened. An empty table writes no rows.
    """
    (shard,) = fresh(docs, "shard")
    placed = _placed(docs, n_shards, tolerance, id_col, text_col, docs.columns)
    out = placed.select(*[F.col("own").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(shard), F.col("key").alias(f"{shard}_key"))
    out.repartitionByRange(shard, f"{shard}_key").sortWithinPartitions(shard, f"{shard}_key").drop(f"{shard}_key").write.partitionBy(shard).parquet(path)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
