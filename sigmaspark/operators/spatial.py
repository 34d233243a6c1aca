"""Boxes that overlap, met in cells whose size follows the boxes.

A grid of one size makes a crowded cell one large join key. Here boxes are counted by the
cell of their corner first, at all depths at once; a cell with too many boxes that are
small against it is split in four, and again. A pair is made in the one cell that holds
the corner of its overlap, at whatever depth that cell is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

#: Boxes of a cell beyond which it is split, and how often a cell may be split.
CROWD, DEEPEST = 2000, 12
#: Split cells up to this number are broadcast.
BROADCAST_CELLS = 200_000
CELL = ["depth", "gx", "gy"]


def _sized(boxes: DataFrame, keys: list[str], box: tuple[str, str, str, str], cell: float) -> DataFrame:
    x0, y0, x1, y1 = box
    side = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    fits = F.when(side > 0, F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.floor(F.log2(cell / (2 * side)))))).otherwise(DEEPEST)
    at = lambda c: F.floor(F.col(c) / (cell / 2**DEEPEST))
    return boxes.select(*keys, fits.cast("int").alias("fits"), at(x0).alias("fx"), at(y0).alias("fy"))


def crowded_cells(sides: list[tuple[DataFrame, tuple[str, str, str, str]]], keys: list[str], cell: float, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """Cells to split (keys, depth, gx, gy), marked for broadcast if they are few, and one more than their largest depth.

    A box counts in the cells of its corner that are at least twice its size: splitting a
    cell for larger ones would only copy them. The counts are partial sums before the exchange.
    """
    corners = None
    for boxes, box in sides:
        own = _sized(boxes, keys, box, cell)
        corners = own if corners is None else corners.unionByName(own)
    finest = corners.groupBy(*keys, "fits", "fx", "fy").agg(F.count("*").alias("n"))
    deep = finest.withColumn("depth", F.explode(F.sequence(F.lit(0), "fits")))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(DEEPEST) - F.col("depth"))).cast("long")
    counted = deep.groupBy(*keys, "depth", up("fx").alias("gx"), up("fy").alias("gy")).agg(F.sum("n").alias("n"))
    spark, path = corners.sparkSession, f"{shared_path(corners.sparkSession)}/cells"
    counted.where((F.col("n") > crowd) & (F.col("depth") < DEEPEST)).select(*keys, *CELL).write.parquet(path)
    split = spark.read.schema(counted.select(*keys, *CELL).schema).parquet(path)
    number, deepest = split.agg(F.count("*"), F.max("depth")).first()
    return (F.broadcast(split) if number <= BROADCAST_CELLS else split), 0 if deepest is None else deepest + 1


def cell_of(c: Column, depth: Column, cell: float) -> Column:
    return F.floor(c / (cell / F.pow(F.lit(2.0), depth))).cast("long")


def in_cells(boxes: DataFrame, keys: list[str], box: tuple[str, str, str, str], split: DataFrame, rounds: int, cell: float) -> DataFrame:
    """The boxes with depth, gx and gy, once for every cell that they touch."""
    x0, y0, x1, y1 = box
    covers = lambda lo, hi: F.explode(F.sequence(cell_of(F.col(lo), F.lit(0), cell), cell_of(F.col(hi), F.lit(0), cell)))
    rows = boxes.withColumn("gx", covers(x0, x1)).withColumn("gy", covers(y0, y1)).withColumn("depth", F.lit(0))
    for _ in range(rounds):
        met = rows.join(split.withColumn("_split", F.lit(True)), [*keys, *CELL], "left")
        child = lambda a, b: F.struct((F.col("depth") + 1).alias("depth"), (2 * F.col("gx") + a).alias("gx"), (2 * F.col("gy") + b).alias("gy"))
        touched = lambda s: s["gx"].between(cell_of(F.col(x0), s["depth"], cell), cell_of(F.col(x1), s["depth"], cell)) & s["gy"].between(cell_of(F.col(y0), s["depth"], cell), cell_of(F.col(y1), s["depth"], cell))
        below = F.filter(F.array(*[child(a, b) for a in (0, 1) for b in (0, 1)]), touched)
        own = F.array(F.struct(F.col("depth"), F.col("gx"), F.col("gy")))
        rows = met.withColumn("_c", F.explode(F.when(F.col("_split"), below).otherwise(own))).drop(*CELL, "_split").select("*", "_c.*").drop("_c")
    return rows


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_box: tuple[str, str, str, str], right_box: tuple[str, str, str, str], cell: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of rows with equal keys whose boxes touch (x_min, y_min, x_max, y_max by name), each once; other columns have to differ in name."""
    split, rounds = crowded_cells([(left, left_box), (right, right_box)], keys, cell, crowd)
    a, b = in_cells(left, keys, left_box, split, rounds, cell), in_cells(right, keys, right_box, split, rounds, cell)
    # boxes in cells are many times the boxes that their size is estimated from: they are never broadcast
    met = a.join(b.hint("merge"), [*keys, *CELL])
    corner = lambda p, q: cell_of(F.greatest(p, q), F.col("depth"), cell)
    mine = (F.col("gx") == corner(left_box[0], right_box[0])) & (F.col("gy") == corner(left_box[1], right_box[1]))
    touch = F.lit(True)
    for k in (0, 1):
        touch = touch & (F.col(left_box[k]) <= F.col(right_box[k + 2])) & (F.col(right_box[k]) <= F.col(left_box[k + 2]))
    return met.where(touch & mine).drop(*CELL)
