"""Evidence around an answer: histories, citations, contexts, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
HISTORY_MESSAGES, HISTORY_EACH, HISTORY_ALL = 12, 2000, 6000
CONTEXT_CHARS, CITATIONS = 12_000, 100


def bounded_text(c: Column, most: int) -> Column:
    """White space collapsed and cut; null if nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(most)), F.lit(""))


def history(messages: DataFrame, each: int = HISTORY_EACH, total: int = HISTORY_ALL, newest: int = HISTORY_MESSAGES) -> DataFrame:
    """conversation, turn, role, content: the newest messages, oldest first, within a budget of characters."""
    back = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    recent = messages.where("status in ('complete', 'streaming')").withColumn("n", F.row_number().over(back)).where(F.col("n") <= newest)
    own = recent.where("role in ('user', 'assistant')").withColumn("content", F.left(F.coalesce("content", F.lit("")), F.lit(each)))
    before = Window.partitionBy("conversation").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    spent = own.withColumn("left", F.lit(total) - F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)))
    return spent.where("left > 0").select("conversation", "turn", "role", F.expr("left(content, cast(left as int))").alias("content"))


def drop_echo(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages without a conversation's newest one where that is the user's question itself."""
    back = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    ranked = messages.withColumn("n", F.row_number().over(back)).join(asked.select("conversation", F.col("question").alias("asked")), "conversation", "left")
    return ranked.where(~((F.col("n") == 1) & (F.col("role") == "user") & F.coalesce(F.col("content") == F.col("asked"), F.lit(False)))).drop("n", "asked")


def newest(rows: DataFrame, by: str | list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each group; of equal times the smallest tie breaker."""
    keys = [by] if isinstance(by, str) else by
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), tie))).where("_n = 1").drop("_n")


def citation_union(parts: list[tuple[DataFrame, int | None]], most: int = CITATIONS) -> DataFrame:
    """scene, source_type, source_id, position: citations of all kinds in the order of the list, kinds and scenes capped."""
    out = None
    for k, (part, cap) in enumerate(parts):
        own = part.select("scene", "source_type", "source_id", "rank").withColumn("kind", F.lit(k))
        if cap is not None:
            own = own.where(F.col("rank") <= cap)
        out = own if out is None else out.unionByName(own)
    order = Window.partitionBy("scene").orderBy("kind", "rank", "source_id")
    return out.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("scene", "source_type", "source_id", "position")


def scene_union(cards: DataFrame, selected: DataFrame) -> DataFrame:
    """query, scene, position: distinct scenes of the cards in order, then the selected one."""
    both = cards.select("query", "scene", F.col("rank").cast("long").alias("p")).unionByName(selected.select("query", "scene", F.lit(1 << 40).cast("long").alias("p")))
    each = both.where("scene is not null").groupBy("query", "scene").agg(F.min("p").alias("p"))
    return each.select("query", "scene", F.row_number().over(Window.partitionBy("query").orderBy("p", "scene")).alias("position"))


def context_text(lines: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """scene, text: a scene's lines in order, cut to a number of characters.

    Lines that begin beyond the limit are dropped by their running length before any are
    gathered, and no line is longer than the limit when it is sorted: a scene's list holds
    little more than the text. Null lines have no place and no length.
    """
    order = Window.partitionBy("scene").orderBy("position", "line").rowsBetween(Window.unboundedPreceding, -1)
    short = lines.select("scene", "position", F.left("line", F.lit(most)).alias("line"))
    begins = F.coalesce(F.sum(F.coalesce(F.length("line") + 1, F.lit(0))).over(order), F.lit(0))
    kept = short.withColumn("begins", begins).where(F.col("begins") <= most)  # the break before a line counts, too
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("scene").agg(F.left(joined, F.lit(most)).alias("text"))


def record_status(size: Column, kind: Column, available: Column, most: int = 2 * 1024 * 1024) -> Column:
    """Whether an evidence record's document can be read."""
    return F.when(size.isNull(), "missing").when((kind != "scene_record") | ~available | (size < 1) | (size > most), "unavailable").otherwise("available")


def availability(status: Column) -> Column:
    return F.when(status.isNull(), "missing").when(status.isin("ready", "pending", "failed", "unavailable"), status).otherwise("unavailable")


def metadata_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one wins; null maps are empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.array_contains(F.map_keys(n), k)), n)
