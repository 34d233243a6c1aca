"""Calibration and noise look-up tables over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .summaries import few, written


def _intervals(nodes: DataFrame, scene: str) -> DataFrame:
    """Cells between neighbouring nodes: start and end in both directions, and the values at the corners."""
    by_line, by_pixel = Window.partitionBy(scene, "pixel").orderBy("line"), Window.partitionBy(scene, "line").orderBy("pixel")
    down = nodes.withColumn("line_end", F.lead("line").over(by_line)).withColumn("a_down", F.lead("a").over(by_line))
    cells = down.withColumn("pixel_end", F.lead("pixel").over(by_pixel)).withColumn("a_right", F.lead("a").over(by_pixel)).withColumn("a_both", F.lead("a_down").over(by_pixel))
    return cells.where("line_end is not null and pixel_end is not null")


def bilinear(pixels: DataFrame, nodes: DataFrame, scene: str = "scene", r: str = "r", c: str = "c", step: int = 64) -> DataFrame:
    """Value at every pixel: range first, then azimuth; beyond the outer nodes the edge's value holds.

    Cells are spread over buckets of ``step`` lines and columns, so pixels and cells meet by
    equal keys; a pixel meets the few cells of its bucket.
    """
    edge = nodes.groupBy(scene).agg(F.min("line").alias("l_min"), F.max("line").alias("l_max"), F.min("pixel").alias("p_min"), F.max("pixel").alias("p_max"))
    inside = lambda x, lo, hi: F.least(F.greatest(F.col(x), F.col(lo)), F.col(hi))
    at = pixels.join(few(written(edge, "edge")), scene).withColumn("y", inside(r, "l_min", "l_max")).withColumn("x", inside(c, "p_min", "p_max")).withColumn("bucket", F.floor(F.least(F.col("y"), F.col("l_max") - 1) / step)).withColumn("bucket_c", F.floor(F.least(F.col("x"), F.col("p_max") - 1) / step))
    cells = _intervals(nodes, scene).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line") / step), F.floor((F.col("line_end") - 1) / step))))
    cells = cells.withColumn("bucket_c", F.explode(F.sequence(F.floor(F.col("pixel") / step), F.floor((F.col("pixel_end") - 1) / step))))
    last_line, last_pixel = F.col("line_end") == F.col("l_max"), F.col("pixel_end") == F.col("p_max")
    here = (F.col("y") >= F.col("line")) & ((F.col("y") < F.col("line_end")) | (last_line & (F.col("y") == F.col("l_max")))) & (F.col("x") >= F.col("pixel")) & ((F.col("x") < F.col("pixel_end")) | (last_pixel & (F.col("x") == F.col("p_max"))))
    met = at.join(cells, [scene, "bucket", "bucket_c"]).where(here)
    fx, fy = (F.col("x") - F.col("pixel")) / (F.col("pixel_end") - F.col("pixel")), (F.col("y") - F.col("line")) / (F.col("line_end") - F.col("line"))
    top, bottom = F.col("a") + (F.col("a_right") - F.col("a")) * fx, F.col("a_down") + (F.col("a_both") - F.col("a_down")) * fx
    return met.select(scene, r, c, (top + (bottom - top) * fy).alias("value"))


def block_factor(pixels: DataFrame, blocks: DataFrame, scene: str = "scene", r: str = "r", c: str = "c") -> DataFrame:
    """Azimuth factor of every pixel: of the last block that its column lies in, 1 outside all.

    A scene has a handful of blocks: they become one array per scene, and no row is multiplied.
    """
    own = blocks.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("block", "first_sample", "last_sample", "factor"))).alias("blocks"))
    fits = F.filter("blocks", lambda b: F.col(c).between(b["first_sample"], b["last_sample"]))
    return pixels.join(few(written(own, "own")), scene, "left").select(scene, r, c, F.coalesce(F.try_element_at(fits, F.lit(-1))["factor"], F.lit(1.0)).alias("factor"))


def summary(nodes: DataFrame, scene: str = "scene") -> DataFrame:
    return nodes.groupBy(scene).agg(F.count_distinct("line").alias("lines"), F.count_distinct("pixel").alias("pixels"), (F.min("a") == F.max("a")).alias("constant"))


def measure_gate(pols: DataFrame, scene: str = "scene") -> DataFrame:
    """A scene can be measured if it has both VV and VH."""
    return pols.groupBy(scene).agg(F.count_distinct("pol").alias("bands"), (F.bool_or(F.col("pol") == "VV") & F.bool_or(F.col("pol") == "VH")).alias("measurable"))
