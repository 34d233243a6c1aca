"""Radar windows: summaries, a scene's thresholds, scattering mechanisms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radiometry import FLOOR_DB, from_db, to_db
from .quantiles import quantiles
from .summaries import between_classes, few, written

# Fixed values
BINS = 256
MIN_WINDOWS, MIN_SPREAD_DB, WATER_PERCENTILE = 200, 8.0, 0.6
FALLBACK_VV, FALLBACK_RATIO = -15.0, -12.0
URBAN_MIN_VV, URBAN_MAX_RATIO, VOLUME_MIN_RVI = -6.0, -8.0, 0.55
MAX_NODATA, MAX_NOISE_LIMITED = 0.40, 0.5
MECHANISMS = ["smooth_surface", "double_bounce", "volume", "rough_surface"]


def nodata_discard(pixels: DataFrame, keys: list[str], bands: list[str], most: float = MAX_NODATA) -> DataFrame:
    """Windows whose share of zero samples, over all bands, is at most ``most``."""
    zeros = sum((F.coalesce(F.col(b), F.lit(0.0)) == 0).cast("int") for b in bands)
    return pixels.groupBy(*keys).agg((F.sum(zeros) / (F.count("*") * len(bands))).alias("nodata_fraction")).where(F.col("nodata_fraction") <= most)


def window_summary(pixels: DataFrame, keys: list[str], vv_db: str = "vv_db", vh_db: str = "vh_db") -> DataFrame:
    """Means of linear power per window, as dB, with ratio, vegetation index and the share of VH at the floor."""
    at_floor = F.avg((from_db(F.col(vh_db)) <= 10.0 ** (FLOOR_DB / 10) * 1.000001).cast("double")).alias("noise_limited_fraction")
    power = pixels.groupBy(*keys).agg(F.avg(from_db(F.col(vv_db))).alias("vv"), F.avg(from_db(F.col(vh_db))).alias("vh"), at_floor)
    return summarise_power(power, keys)


def summarise_power(power: DataFrame, keys: list[str]) -> DataFrame:
    """vv_db, vh_db, ratio_db and rvi from mean linear powers ``vv`` and ``vh``."""
    floor = F.lit(10.0 ** (FLOOR_DB / 10))
    vv_db, vh_db = to_db(F.greatest("vv", floor)), to_db(F.greatest("vh", floor))
    rvi = F.when(F.col("vv") + F.col("vh") > 0, 4 * F.col("vh") / (F.col("vv") + F.col("vh"))).otherwise(0.0)
    return power.select(*keys, vv_db.alias("vv_db"), vh_db.alias("vh_db"), (vh_db - vv_db).alias("ratio_db"), rvi.alias("rvi"), "noise_limited_fraction")


def otsu(values: DataFrame, scene: str, value: str, bins: int = BINS) -> DataFrame:
    """Per scene the centre of the bin that parts its values best (largest variance between classes, first of equals).

    A scene of one value gives that value.
    """
    spread = written(values.groupBy(scene).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "spread")
    width = (F.col("hi") - F.col("lo")) / bins
    binned = values.join(few(spread), scene).where("hi > lo").withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    best = between_classes(binned.groupBy(scene, "lo", "hi", "bin").agg(F.count("*").alias("n")), scene, bins)
    return spread.join(best, scene, "left").select(scene, F.coalesce("otsu", "lo").alias("otsu"))


def fit_thresholds(windows: DataFrame, scene: str = "scene") -> DataFrame:
    """One row per scene: the five thresholds, their source, and why a fit was refused.

    The windows are written once, so that pixels behind them are read once; no buffer holds a scene.
    """
    held = written(windows.select(scene, "vv_db", "ratio_db"), "windows")
    return _fitted(held, scene)


def _fitted(held: DataFrame, scene: str) -> DataFrame:
    stats = quantiles(held, scene, "vv_db", [0.05, WATER_PERCENTILE, 0.95]).select(scene, "p")
    sizes = held.groupBy(scene).agg(F.count("*").alias("windows"))
    fitted = sizes.join(stats, scene, "left").join(otsu(held, scene, "ratio_db"), scene)
    reason = degenerate_reason(F.col("windows"), F.col("p")[1], F.col("p")[2] - F.col("p")[0])
    return fitted.withColumn("reason", reason).select(
        scene, "windows",
        F.when(F.col("reason").isNull(), F.col("p")[1]).otherwise(FALLBACK_VV).alias("water_max_vv_db"),
        F.when(F.col("reason").isNull(), F.col("otsu")).otherwise(FALLBACK_RATIO).alias("water_max_ratio_db"),
        F.lit(URBAN_MIN_VV).alias("urban_min_vv_db"), F.lit(URBAN_MAX_RATIO).alias("urban_max_ratio_db"), F.lit(VOLUME_MIN_RVI).alias("volume_min_rvi"),
        F.when(F.col("reason").isNull(), "fitted").otherwise("fallback").alias("source"), "reason")


def degenerate_reason(windows: Column, water_vv: Column, spread: Column) -> Column:
    """Why a scene can't be fitted, or null."""
    return F.when(windows < MIN_WINDOWS, "too_few_windows").when(water_vv >= URBAN_MIN_VV, "classes_overlap").when(spread < MIN_SPREAD_DB, "narrow_spread")


def mechanism() -> Column:
    """Mechanism of a row with vv_db, ratio_db, rvi and thresholds; the specific ones are asked first."""
    smooth = (F.col("vv_db") <= F.col("water_max_vv_db")) & (F.col("ratio_db") <= F.col("water_max_ratio_db"))
    double = (F.col("vv_db") >= F.col("urban_min_vv_db")) & (F.col("ratio_db") <= F.col("urban_max_ratio_db"))
    return F.when(smooth, MECHANISMS[0]).when(double, MECHANISMS[1]).when(F.col("rvi") >= F.col("volume_min_rvi"), MECHANISMS[2]).otherwise(MECHANISMS[3])


def classify(windows: DataFrame, thresholds: DataFrame, scene: str = "scene") -> DataFrame:
    """Windows with their mechanism; a scene has one row of thresholds."""
    return windows.join(thresholds, scene).withColumn("mechanism", mechanism())


def mechanism_block(windows: DataFrame, scene: str = "scene", most_noise: float = MAX_NOISE_LIMITED) -> DataFrame:
    """Per scene and mechanism: share, medians, and windows scored and discarded. Thresholds use all windows."""
    held = written(windows.select(scene, "vv_db", "ratio_db", "rvi", "noise_limited_fraction"), "windows")
    thresholds = few(written(_fitted(held, scene), "thresholds"))
    marked = classify(held, thresholds, scene).withColumn("usable", F.col("noise_limited_fraction") <= most_noise)
    by = marked.groupBy(scene, "source", "mechanism").agg(F.count_if("usable").alias("n"), F.count_if(~F.col("usable")).alias("lost"))
    # medians by mechanism: a group is a scene and a mechanism
    group = F.concat_ws("\u0000", F.col(scene).cast("string"), "mechanism").alias("_group")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ("vv_db", "ratio_db")])).alias("x")
    usable = marked.where("usable").select(group, both).select(F.concat_ws("\u0000", "_group", "x.c").alias("_group"), "x.v")
    found = quantiles(usable, "_group", "v", [0.5]).select(F.split("_group", "\u0000").alias("k"), F.col("p")[0].alias("m"))
    medians = found.groupBy(F.concat_ws("\u0000", F.col("k")[0], F.col("k")[1]).alias("_group")).agg(*[F.max(F.when(F.col("k")[2] == c, F.col("m"))).alias(f"median_{c}") for c in ("vv_db", "ratio_db")])
    by = by.withColumn("_group", group).join(medians, "_group", "left")
    whole = Window.partitionBy(scene)  # four rows a scene
    return by.withColumn("windows_scored", F.sum("n").over(whole)).withColumn("windows_discarded", F.sum("lost").over(whole)).where("n > 0").select(
        scene, "source", "mechanism", "windows_scored", "windows_discarded", (F.col("n") / F.col("windows_scored")).alias("fraction"), "median_vv_db", "median_ratio_db")
