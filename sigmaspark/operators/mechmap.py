"""Maps of block means: power sums per cell, labels, majority filter, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scattering import MECHANISMS, mechanism, summarise_power
from .summaries import few, written

# Fixed values
TARGET_METRES, TARGET_WIDTH, MIN_VALID = 60.0, 4096, 0.5
METRES_PER_DEGREE = 111_320.0


def ground_sampling(pixel_width: Column, geographic: Column, centre_lat: Column, fallback: float = 10.0) -> Column:
    """Metres per pixel; degrees at the raster's own latitude; the fallback without a georeference."""
    per_degree = METRES_PER_DEGREE * F.greatest(F.cos(F.radians(centre_lat)), F.lit(1e-6))
    size = F.abs(pixel_width)
    return F.when(size.isNull() | (size <= 0) | geographic.isNull(), fallback).when(geographic, size * per_degree).otherwise(size)


def block_factor(sampling: Column, width: Column, target_width: int = TARGET_WIDTH) -> Column:
    """Pixels per cell edge: enough looks for the target ground size, and no map wider than the target."""
    looks = F.bround(TARGET_METRES / F.greatest(sampling, F.lit(0.1)), 0).cast("int")
    return F.greatest(looks, F.floor(width / target_width).cast("int"), F.lit(1))


def block_mean_grid(pixels: DataFrame, block: int, rows: int, cols: int, scene: str = "scene", r: str = "r", c: str = "c", vv: str = "vv", vh: str = "vh", min_valid: float = MIN_VALID) -> DataFrame:
    """Mean linear power per block x block cell; ragged edges are dropped, a pixel with a zero band doesn't count.

    Cells with too few valid pixels have null powers. Partial sums leave each task, so one
    large scene spreads over its cells.
    """
    valid = (F.col(vv) > 0) & (F.col(vh) > 0)
    inside = pixels.where((F.col(r) < rows // block * block) & (F.col(c) < cols // block * block))
    cells = inside.groupBy(scene, F.floor(F.col(r) / block).cast("int").alias("cell_row"), F.floor(F.col(c) / block).cast("int").alias("cell_col")).agg(
        F.sum(F.when(valid, F.col(vv))).alias("vv_sum"), F.sum(F.when(valid, F.col(vh))).alias("vh_sum"), F.count_if(valid).alias("valid"), F.count("*").alias("pixels"))
    return cells.select(scene, "cell_row", "cell_col", "valid", "pixels", *[F.when(covered(F.col("valid"), F.col("pixels"), min_valid), F.col(f"{b}_sum") / F.col("valid")).alias(b) for b in ("vv", "vh")])


def covered(valid: Column, pixels: Column, min_valid: float = MIN_VALID) -> Column:
    return valid / pixels >= min_valid


def label_cells(cells: DataFrame, thresholds: DataFrame, scene: str = "scene") -> DataFrame:
    """scene, cell_row, cell_col, label: the mechanism's number, null without data."""
    power = summarise_power(cells.withColumn("noise_limited_fraction", F.lit(0.0)), [scene, "cell_row", "cell_col", "vv"])
    named = power.join(thresholds, scene).withColumn("mechanism", mechanism())
    number = F.array_position(F.array(*map(F.lit, MECHANISMS)), F.col("mechanism")) - 1
    return named.select(scene, "cell_row", "cell_col", F.when(F.col("vv").isNotNull(), number).cast("int").alias("label"))


def neighbours(cells: DataFrame, scene: str = "scene", rows: str = "rows", cols: str = "cols") -> DataFrame:
    """Each cell with the labels of its 3 x 3 neighbourhood; beyond the edge the edge's cells are repeated."""
    size = cells.groupBy(scene).agg(F.max("cell_row").alias(rows), F.max("cell_col").alias(cols))
    steps = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))"))
    spread = cells.select(scene, "cell_row", "cell_col", "label", steps.alias("s")).join(few(written(size, "size")), scene)
    near = [F.least(F.greatest(F.col(x) + F.col(f"s.{s}"), F.lit(0)), F.col(n)).alias(f"near_{x}") for x, s, n in (("cell_row", "a", rows), ("cell_col", "b", cols))]
    other = cells.select(F.col(scene), F.col("cell_row").alias("near_cell_row"), F.col("cell_col").alias("near_cell_col"), F.col("label").alias("near_label"))
    return spread.select(scene, "cell_row", "cell_col", "label", *near).join(other, [scene, "near_cell_row", "near_cell_col"])


def majority_filter(cells: DataFrame, scene: str = "scene") -> DataFrame:
    """The most frequent label around each cell, the lowest of equals; cells without data stay so.

    Each cell sends its label to the cells around it, more than once where the edge is
    repeated; the votes for each label are partial sums, so there is one exchange.
    """
    size = cells.groupBy(scene).agg(F.max("cell_row").alias("rows"), F.max("cell_col").alias("cols"))
    steps = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))"))
    sent = cells.join(few(written(size, "size")), scene).select(scene, "cell_row", "cell_col", "label", "rows", "cols", steps.alias("s"))
    own = (F.col("s.a") == 0) & (F.col("s.b") == 0)
    times = lambda x, step, last: F.lit(1) + F.when((F.col(step) == 0) & (F.col(x) == 0), 1).otherwise(0) + F.when((F.col(step) == 0) & (F.col(x) == F.col(last)), 1).otherwise(0)
    row, col = F.col("cell_row") + F.col("s.a"), F.col("cell_col") + F.col("s.b")
    sent = sent.where(row.between(0, F.col("rows")) & col.between(0, F.col("cols")))
    sent = sent.select(scene, row.alias("cell_row"), col.alias("cell_col"), "label", (times("cell_row", "s.a", "rows") * times("cell_col", "s.b", "cols")).alias("times"), own.alias("own"))
    votes = [F.coalesce(F.sum(F.when(F.col("label") == k, F.col("times"))), F.lit(0)).alias(f"votes_{k}") for k in range(len(MECHANISMS))]
    counted = sent.groupBy(scene, "cell_row", "cell_col").agg(F.max(F.when(F.col("own"), F.col("label"))).alias("label"), F.bool_or("own").alias("there"), *votes)
    best = F.array_max(F.array(*[F.struct(F.col(f"votes_{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(MECHANISMS))]))
    return counted.where("there").select(scene, "cell_row", "cell_col", F.when(F.col("label").isNotNull(), -best["k"]).cast("int").alias("label"))


def map_fractions(cells: DataFrame, scene: str = "scene") -> DataFrame:
    """Share of each mechanism over cells with data, and the share of those cells."""
    shares = [F.coalesce(F.avg(F.when(F.col("label").isNotNull(), (F.col("label") == k).cast("double"))), F.lit(0.0)).alias(m) for k, m in enumerate(MECHANISMS)]
    return cells.groupBy(scene).agg(*shares, F.avg(F.col("label").isNotNull().cast("double")).alias("valid_fraction"))


def adopt_map_fractions(sampled: DataFrame, fractions: DataFrame, scene: str = "scene") -> DataFrame:
    """Sampled shares replaced by the dense map's where there is one; shares of zero go."""
    long = fractions.select(scene, F.explode(F.map_from_arrays(F.array(*map(F.lit, MECHANISMS)), F.array(*MECHANISMS))).alias("mechanism", "map_fraction"))
    both = sampled.join(long, [scene, "mechanism"], "left")
    return both.select(scene, "mechanism", F.coalesce("map_fraction", "fraction").alias("fraction"), F.when(F.col("map_fraction").isNotNull(), "dense_map").otherwise("sampled").alias("fraction_source")).where("fraction > 0")
