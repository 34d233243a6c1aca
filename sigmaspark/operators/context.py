"""Scene context: land and water by brightness, land cover by a classifier's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.radiometry import to_db
from .summaries import clipped_cut

# Fixed values
MIN_PIXELS, MIN_CONTRAST_DB, SPAN_DB = 64, 0.25, 12.0
WATER_SHARE, LAND_SHARE = 0.7, 0.3
CONFIDENT, MIN_SHARE = 0.95, 0.05
DOMAIN_LON, DOMAIN_LAT = (-31.3, 31.6), (36.0, 70.1)


def land_water(pixels: DataFrame, bands: list[str], scene: str = "scene") -> DataFrame:
    """Per scene: label, water share, threshold and separability, from the mean magnitude of its bands. Pixels are scanned twice."""
    mean = sum(F.abs(F.col(b)) for b in bands) / len(bands)
    db = pixels.select(scene, to_db(F.greatest(mean, F.lit(1e-12))).alias("db")).where("db is not null and not isnan(db)")
    cut = clipped_cut(db, scene, "db", 0.02, 0.98, least=MIN_PIXELS, contrast=MIN_CONTRAST_DB)
    label = F.when(F.col("below") >= WATER_SHARE, "likely_water_dominant").when(F.col("below") <= LAND_SHARE, "likely_land_dominant").when(F.col("below").isNotNull(), "mixed_or_indeterminate").otherwise("indeterminate")
    separability = F.when(F.col("otsu").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("hi") - F.col("lo")) / SPAN_DB)))
    return cut.select(scene, label.alias("label"), F.col("below").alias("water_fraction"), F.col("otsu").alias("threshold_db"), separability.alias("separability"))


def scene_classes(scores: DataFrame, scene: str = "scene", confident: float = CONFIDENT, min_share: float = MIN_SHARE) -> DataFrame:
    """Per scene and class of ``scores`` (an array per window): mean, share of confident windows; the rare ones go."""
    each = scores.select(scene, F.posexplode("scores").alias("class", "p"))
    out = each.groupBy(scene, "class").agg(F.avg("p").alias("mean_probability"), F.avg((F.col("p") >= confident).cast("double")).alias("present_share"))
    return out.where(F.col("present_share") >= min_share)


def domain_gate(lon: Column, lat: Column) -> Column:
    inside = lon.between(*DOMAIN_LON) & lat.between(*DOMAIN_LAT)
    return F.when(lon.isNull() | lat.isNull(), "unknown").when(inside, "plausible").otherwise("out_of_domain")


def land_cover_status(domain: Column, has_result: Column) -> Column:
    """Fails closed: classes are shown only for a result inside the classifier's domain."""
    return F.when(~F.coalesce(has_result, F.lit(False)), "unavailable").when(domain == "out_of_domain", "out_of_domain").when(domain == "unknown", "domain_unverified").otherwise("available")
