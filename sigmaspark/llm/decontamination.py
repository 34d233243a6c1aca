"""Benchmark decontamination by spaced seeds.

Fixed masks pick words of a window and ignore the others, so a substituted word that a
mask ignores doesn't hide a copy. Hashes of the picked words are joined between
benchmark items and documents; each hit fixes a diagonal, on which the item is compared
word by word.

Tolerance: an item is found where WINDOW consecutive words of it (all words of a shorter
item) stand in the document with up to 2 substitutions (up to 1 for items of 8 to 11
words, none below). The two masks hit every such place: whichever words are substituted,
one of the masks picks only others at some offset. Items under INSIDE words are common
speech: they are found only where a document is that item and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, cut, fresh, table

WINDOW = 12
MASKS = [(0, 1, 2, 4, 5), (0, 1, 4, 6, 7)]
SEEDED = 8  # items with fewer words are sought whole
INSIDE = 4  # items with fewer words must be the whole document
#: Seeds, items and ids of a benchmark that need more than this in memory are not broadcast.
BROADCAST_BYTES = 64_000_000
#: What a seed and an id take in a hash table.
SEED_BYTES, ID_BYTES = 100, 64
#: So many positions of a document are looked up before their hits are compared.
PIECE = 512
#: Bits of a slice of the filter of seeds, and how many slices there may be (32 MB).
SLICE_BITS, SLICES = 1 << 17, 2048
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits; the empty strings that a split leaves at the ends are dropped."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"^{NOT_WORD}|{NOT_WORD}$", ""), NOT_WORD)


def _seed(mask_id: Column, words: str, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(mask_id, *[F.get(words, at + p) for p in mask])


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(id, mask): the spaced masks, and a mask of all words for each length of short items."""
    return [*((k, m) for k, m in enumerate(MASKS)), *((100 + n, tuple(range(n))) for n in short)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted), overlap, text_key.

    ``overlap`` is the largest share of a window's words found in place, 0 without a hit.
    Items without words or without an id never match; repeated items count once by id. Null
    texts have no words; null and repeated document ids are carried along, one result row per input row.
    Other columns are not read. Empty tables give an empty result or no contamination.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _words(F.col(item_text_col)).alias("item")).where((F.col("item")[0] != "") & F.col("item_id").isNotNull())
    # equal items are sought once, however many ids they have
    texts = cut(items.select("item").distinct().select(F.monotonically_increasing_id().alias("text_no"), "item"), "items")
    ids = items.join(texts, "item").select("text_no", "item_id").distinct()
    sums = texts.agg(F.sum(F.size("item")).alias("words"), F.sum(24 * F.size("item") + F.octet_length(F.array_join("item", "")) + 64).alias("bytes"), F.max(F.size("item")).alias("longest"), F.array_sort(F.collect_set(F.when(F.size("item") < SEEDED, F.size("item")))).alias("short")).first()
    masks = _masks(sums.short)
    n_seeds, text_bytes = (sums.words or 0) * len(masks), sums.bytes or 0

    fits = [F.when(F.col("j") + (max(m) + 1) <= F.size("item"), F.struct(_seed(F.lit(k), "item", F.col("j"), m).alias("seed"), F.lit(k).alias("mask"))) for k, m in masks[: len(MASKS)]]
    fits += [F.when((F.col("j") == 0) & (F.size("item") == len(m)), F.struct(_seed(F.lit(k), "item", F.col("j"), m).alias("seed"), F.lit(k).alias("mask"))) for k, m in masks[len(MASKS) :]]
    seeds = texts.select("text_no", "item", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("j"))
    seeds = seeds.select("text_no", F.size("item").alias("n"), "j", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("s")).select("text_no", "n", "j", "s.seed", "s.mask")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row"), _words(F.col(text_col)).alias("words"))
    if n_seeds * SEED_BYTES + text_bytes + items.count() * ID_BYTES <= BROADCAST_BYTES:
        leaks = _probed(rows, seeds.drop("n"), texts, ids, masks, sums.longest or 0)
    else:
        leaks = _exchanged(cut(rows, "words"), seeds.drop("mask"), F.broadcast(texts) if text_bytes <= BROADCAST_BYTES else texts, ids, masks, n_seeds)
    return leaks.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "overlap", "text_key")


def _hashes(masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    return F.array(*[_seed(F.lit(k), "words", F.col("i"), m) for k, m in masks])


def _probed(rows: DataFrame, seeds: DataFrame, texts: DataFrame, ids: DataFrame, masks: list[tuple[int, tuple[int, ...]]], longest: int) -> DataFrame:
    """Seeds, items and their ids are broadcast. Position -1 stands for the document itself and joins a row of its own: no exchange before the last.

    Spark holds all rows that a row grows into until the next operator without generated code, so documents come in pieces (of ``PIECE``
    positions, with the words about them that items reach), and a hit leaves with the words on its diagonal, not with the document.
    """
    size = max(PIECE, longest)
    piece = lambda k: F.struct(F.when(k == 0, -1).otherwise(longest).alias("low"), F.least(F.col("n_words") - F.greatest(k - longest, F.lit(0)), F.least(k, F.lit(longest)) + size).alias("high"), F.slice("words", F.greatest(k - longest, F.lit(0)) + 1, F.lit(size + 2 * longest)).alias("words"))
    counted = rows.withColumn("n_words", F.size("words"))
    pieces = counted.select("doc_id", "text_key", "row", "n_words", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(size)), piece)).alias("p")).select("doc_id", "text_key", "row", "n_words", "p.*")
    each = pieces.select("doc_id", "text_key", "row", "n_words", "words", F.explode(F.sequence("low", F.col("high") - 1)).alias("i"))
    probes = each.select("doc_id", "text_key", "row", "n_words", "words", "i", F.explode(F.when(F.col("i") < 0, F.array(F.lit(0).cast("long"))).otherwise(_hashes(masks))).alias("seed"))
    own = rows.sparkSession.createDataFrame([(None, 0, 0, None)], "text_no bigint, j int, seed bigint, mask int")
    hits = probes.join(F.broadcast(seeds.unionByName(own)), "seed").join(F.broadcast(texts), "text_no", "left")
    # a hit whose left neighbour is a hit of the same mask is skipped: same diagonal
    before = F.lit(False)
    for k, m in masks[: len(MASKS)]:
        same = F.lit(True)
        for p in m:
            same = same & F.coalesce(F.get("words", F.col("i") + (p - 1)) == F.get("item", F.col("j") + (p - 1)), F.lit(False))
        before = before | ((F.col("mask") == k) & (F.col("j") > 0) & (F.col("i") > 0) & same)
    at = F.col("i") - F.col("j")
    parts = hits.where(F.col("text_no").isNull() | ~before).select("row", "doc_id", "text_key", "text_no", "item", "n_words", *_beside(at, F.size("item")))
    verified = parts.select("row", "doc_id", "text_key", "text_no", F.when(F.col("item").isNotNull(), _verified()).alias("v")).select("row", "doc_id", "text_key", F.when(F.col("v.leak"), F.col("text_no")).alias("text_no"), "v.overlap")
    return verified.join(F.broadcast(ids), "text_no", "left").groupBy("row", "doc_id", "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.coalesce(F.max("overlap"), F.lit(0.0)).alias("overlap"))


def _exchanged(rows: DataFrame, seeds: DataFrame, texts: DataFrame, ids: DataFrame, masks: list[tuple[int, tuple[int, ...]]], n_seeds: int) -> DataFrame:
    """For benchmarks of any size. Only positions that pass a filter of all seeds are exchanged; a diagonal is compared once, and takes
    along the document's words that it needs, not the document."""
    probes = rows.select("row", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i")).select("row", "i", F.explode(_hashes(masks)).alias("seed"))
    found = _passed(probes, seeds, n_seeds).join(seeds, "seed").select("row", "text_no", "n", (F.col("i") - F.col("j")).alias("at")).repartition("row").distinct()
    # words are exchanged as one text, a third of their size as an array
    whole = rows.select("row", F.array_join("words", " ").alias("joined")).repartition("row").select("row", F.split("joined", " ").alias("words"))
    parts = found.join(whole, "row").select("row", "text_no", F.size("words").alias("n_words"), *_beside(F.col("at"), F.col("n")))
    verified = parts.join(texts, "text_no").select("row", "text_no", _verified().alias("v"))
    best = cut(verified.groupBy("row").agg(F.collect_set(F.when(F.col("v.leak"), F.col("text_no"))).alias("texts"), F.max("v.overlap").alias("overlap")), "best")
    named = best.select("row", F.explode("texts").alias("text_no")).join(ids, "text_no").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    leaks = rows.select("row", "doc_id", "text_key").join(best.select("row", "overlap"), "row", "left").join(named, "row", "left")
    return leaks.withColumns({"item_ids": F.coalesce("item_ids", F.array().cast("array<bigint>")), "overlap": F.coalesce("overlap", F.lit(0.0))})


def _passed(probes: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    """The probes whose seed may be one of ``seeds``: two bits of a slice of bits are set for each. Slices are broadcast, ``SLICES`` at most;
    where seeds are too many for them, more probes pass that no seed equals, which the join drops."""
    slices = min(SLICES, 16 * n_seeds // SLICE_BITS + 1)
    of = F.expr(f"pmod(seed, {slices}L)")
    bits = [F.shiftrightunsigned("seed", by).bitwiseAND(F.lit(SLICE_BITS - 1).cast("long")) for by in (20, 42)]
    marks = seeds.select(of.alias("slice"), F.explode(F.array(*bits)).alias("b")).select("slice", F.expr("b div 64").alias("word"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("mark"))
    none = seeds.sparkSession.range(slices * SLICE_BITS // 64).selectExpr(f"id div {SLICE_BITS // 64} as slice", f"id % {SLICE_BITS // 64} as word", "0L as mark")
    words = marks.unionByName(none).groupBy("slice", "word").agg(F.bit_or("mark").alias("mark"))
    table = words.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mark"))), lambda x: x["mark"]).alias("marks"))
    near = probes.select("*", of.alias("slice"), *[b.alias(f"b{k}") for k, b in enumerate(bits)]).join(F.broadcast(table), "slice")
    for k in range(len(bits)):
        near = near.where(F.expr(f"shiftright(get(marks, cast(b{k} div 64 as int)), cast(b{k} % 64 as int)) & 1L = 1L"))
    return near.select("row", "i", "seed")


def _beside(at: Column, n: Column) -> list[Column]:
    """The words beside an item of n words that begins at a place, which may lie before the first, and how many it has before the first."""
    return [F.slice("words", F.greatest(at, F.lit(0)) + 1, n + F.least(at, F.lit(0))).alias("part"), F.greatest(-at, F.lit(0)).alias("skip")]


def _verified() -> Column:
    """Compare an item with ``part``, a document's words on one diagonal."""
    n = F.size("item")
    width = F.least(n, F.lit(WINDOW))
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.get("part", k - F.col("skip")) == F.get("item", k), F.lit(False)))
    # a window's most equal words: one more wherever as many and one, up to the place at hand, lie within its width
    most = lambda at: F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda m, r: m + F.when(F.get(at, r) - F.get(at, r - m) < width, 1).otherwise(0))
    best = F.get(F.transform(F.array(same), most), F.lit(0))  # a lambda's argument is computed once
    allowed = F.when(width >= WINDOW, 2).when(width >= SEEDED, 1).otherwise(0)
    # another lambda's argument, for ``best`` is read twice
    judged = F.transform(F.array(best), lambda m: F.struct(((m >= width - allowed) & ((n >= INSIDE) | (F.col("n_words") == n))).alias("leak"), (m / width).alias("overlap")))
    return F.get(judged, F.lit(0))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without contamination, all columns; a row is known by its id and text."""
    doc_id, key = fresh(docs, "__id", "__key")
    leaked = find_leaks(docs, benchmark, id_col, text_col, **names).where("contaminated").select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct()
    return docs.join(broadcast_if_few(leaked), F.col(id_col).cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(text_col) == F.col(key)), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join("item_ids", ",").alias("item_ids"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM b),
eq AS (SELECT r, item_id, n, i - j AS diag, j FROM dw JOIN bw USING (w)),
best AS (SELECT r, item_id, n, max(c) AS m FROM (
    SELECT r, item_id, n, count(*) OVER (PARTITION BY r, item_id, diag ORDER BY j RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c FROM eq) GROUP BY r, item_id, n),
hit AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM best
    WHERE m >= least(n, {WINDOW}) - CASE WHEN n >= {WINDOW} THEN 2 WHEN n >= {SEEDED} THEN 1 ELSE 0 END
    AND (n >= {INSIDE} OR n = (SELECT len(ws) FROM d WHERE d.r = best.r)) GROUP BY r)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(len(items), 0)::BIGINT AS n_items, array_to_string(coalesce(items, []), ',') AS item_ids
FROM d LEFT JOIN hit USING (r)
"""
