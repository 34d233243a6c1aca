"""Quality rules: counts of a document itself, and the frequency of its lines across its host's documents.

Lines are normalised and hashed. A line that occurs in too many different documents of a
host is boilerplate: it is removed, and a document that loses too much is rejected.
Exact copies of one document are not different documents: documents count as different
if their texts differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, cut, forget, fresh, table

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is removed if more than MIN_DOCS different documents and more than HOST_SHARE of the host's rows have it.
MIN_DOCS, HOST_SHARE = 20, 0.05
#: A document is depleted if fewer than MIN_WORDS words or less than KEPT_SHARE of its words are left.
KEPT_SHARE = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def line_key(line: bytes) -> int:
    """60-bit hash of a line: ASCII lower case, digits as 0, white space collapsed."""
    return int(hashlib.md5(b" ".join(line.lower().translate(_DIGITS).split())).hexdigest()[:15], 16)


def line_key_column(line: Column) -> Column:
    """``line_key`` as a column."""
    flat = F.trim(F.regexp_replace(F.translate(line, ASCII_UPPER + "123456789", ASCII_LOWER + "000000000"), r"[\x20\x09-\x0D]+", " "))
    return F.conv(F.substring(F.md5(flat), 1, 15), 16, 10).cast("long")


def _repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more."""
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    ids = (ids + np.uint64(1)) * _MIX[0]
    ids ^= ids >> np.uint64(29)
    n = len(words) - window + 1
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += ids[k : k + n] * _MIX[k]
        keys ^= keys >> np.uint64(31)
        keys *= _MIX[1]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.concatenate([[0], np.cumsum(np.isin(keys, twice))])
    at = np.arange(len(words))
    return int(np.count_nonzero(found[np.minimum(at + 1, n)] > found[np.maximum(at - window + 1, 0)]))


def _measure(text: str | None) -> tuple[tuple[int, ...], list[tuple[int, int]]]:
    """The five counts, and (hash, words) of each different line."""
    raw = (text or "").encode()
    letters = np.frombuffer(raw, np.uint8)
    words = raw.split()
    word_chars = int(np.count_nonzero(((letters & 0xC0) != 0x80) & ~_SPACE[letters]))
    seen: set[bytes] = set()
    own: dict[int, int] = {}
    repeated = 0
    for line in raw.split(b"\n"):
        if n := len(line.split()):
            repeated += line in seen
            seen.add(line)
            key = line_key(line)
            own[key] = own.get(key, 0) + n
    return (len(words), word_chars, int(np.count_nonzero(_SYMBOL[letters])), repeated, _repeated_words(words)), list(own.items())


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id bigint, host string, text_key bigint, row bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", lines array<struct<line:bigint,words:bigint>>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        counts, lines = zip(*map(_measure, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
        flat = [x for own in lines for x in own]
        items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)], ["line", "words"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in lines])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host", "text_key", "row")), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)), pa.ListArray.from_arrays(offsets, items)],
            ["doc_id", "host", "text_key", "row", *_COUNTS, "lines"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS,
                  host_share: float = HOST_SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, removed_words, removed (line hashes), kept, and host and text_key.

    Null texts are empty (base_failed); a null host is the empty host; null and repeated
    ids are carried along, every row is judged for itself. Only the three named columns are
    read. An empty table gives an empty result. All lines of all rows are counted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    measured = cut(rows.mapInArrow(_measured, _SCHEMA), "measured")

    lines = measured.select("row", "host", F.col("text_key").alias("page"), F.explode("lines").alias("x")).select("row", "host", "page", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    different = lines.groupBy("host", "line", "page").agg(F.count("*").alias("rows")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_rows"))
    frequent = cut(different.join(hosts, "host").where(F.col("n_docs") > host_share * F.col("host_rows")).select("host", "line"), "frequent")
    lost = lines.join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))

    judged = measured.join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < kept_share * F.col("n_words")))
    return judged.select("doc_id", *_COUNTS, base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), "removed_words", "removed", "host", "text_key")


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that ``quality_rules`` keeps, all columns, without the lines above the limits.

    Where lines go, ``n_chars`` follows if it is an integer column. Nulls and repeated rows
    as there; a row is known by its id, host and text.
    """
    verdicts = quality_rules(docs, id_col, text_col, host_col, **limits).where("kept")
    doc_id, host, key, removed = fresh(docs, "__doc_id", "__host", "__key", "__removed")
    once = verdicts.groupBy(F.col("doc_id").alias(doc_id), F.col("host").alias(host), F.col("text_key").alias(key)).agg(F.first("removed").alias(removed))
    kept = docs.join(once, F.col(id_col).cast("long").eqNullSafe(F.col(doc_id)) & (F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(host)) & (F.xxhash64(text_col) == F.col(key)))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(removed, line_key_column(x)))
    text = F.when(F.col(removed).isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text_col))
    new = {text_col: text}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        new["n_chars"] = F.when(F.col(removed).isNotNull(), F.char_length(text)).otherwise(F.col("n_chars"))
    return kept.select(*[new[c].cast(t).alias(c) if c in new else F.col(c) for c, t in docs.dtypes])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept", "removed_words")


OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM docs),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
ln AS (SELECT r, host, n, l, len(list_filter(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS nw FROM (
    SELECT r, host, unnest(range(len(string_split(t, chr(10))))) AS n, unnest(string_split(t, chr(10))) AS l FROM docs)),
real AS (SELECT *, ('0x' || substr(md5(trim(regexp_replace(translate(l, '{ASCII_UPPER}123456789', '{ASCII_LOWER}000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))), 1, 15))::BIGINT AS k FROM ln WHERE nw > 0),
dup AS (SELECT r, sum(m - 1) AS n FROM (SELECT r, l, count(*) AS m FROM real GROUP BY r, l) GROUP BY r),
own AS (SELECT r, any_value(host) AS host, k, sum(nw) AS words FROM real GROUP BY r, k),
page AS (SELECT r, md5(t) AS page FROM docs),
freq AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT page) AS n FROM own JOIN page USING (r) GROUP BY host, k)
    JOIN (SELECT host, count(*) AS h FROM docs GROUP BY host) USING (host) WHERE n > {MIN_DOCS} AND n > {HOST_SHARE} * h),
lost AS (SELECT r, sum(words) AS n FROM own JOIN freq USING (host, k) GROUP BY r),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
    FROM docs JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {MIN_WORDS} OR n_words - removed_words < {KEPT_SHARE} * n_words)) AS kept, removed_words
FROM failed
"""
