"""Footprints, coordinates, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import haversine_km


def parse_footprint(text: Column, strict: bool = True) -> Column:
    """Corners (lat, lon) of 'lat,lon lat,lon ...'. Strict: any bad corner, or fewer than three, gives null; else bad ones are left out."""
    corner = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("lat"), F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("lon"), F.size(F.split(p, ",")).alias("n")))
    good = lambda x: (x["n"] == 2) & x["lat"].isNotNull() & x["lon"].isNotNull()
    kept = F.transform(F.filter(corner, good), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    ok = (F.size(kept) >= 3) & F.forall(corner, good) if strict else F.size(kept) >= 1
    return F.when(ok, kept)


def footprint_stats(footprints: DataFrame, key: str, corners: str = "corners") -> DataFrame:
    """Centroid (mean of the corners) and ground extent: means of opposite sides of four corners, else the longest and shortest side; the width is the larger."""
    lat, lon = F.transform(corners, lambda p: p["lat"]), F.transform(corners, lambda p: p["lon"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(corners)
    side = lambda i: haversine_km(F.get(lat, i), F.get(lon, i), F.get(lat, (i + 1) % F.size(corners)), F.get(lon, (i + 1) % F.size(corners)))
    base = footprints.where(F.col(corners).isNotNull()).select(key, corners, mean(lat).alias("lat"), mean(lon).alias("lon"), F.transform(F.sequence(F.lit(0), F.size(corners) - 1), side).alias("sides"))
    one = F.when(F.size("sides") == 4, (F.col("sides")[0] + F.col("sides")[2]) / 2).otherwise(F.array_max("sides"))
    two = F.when(F.size("sides") == 4, (F.col("sides")[1] + F.col("sides")[3]) / 2).otherwise(F.array_min("sides"))
    return base.select(key, "lat", "lon", F.greatest(one, two).alias("width_km"), F.least(one, two).alias("height_km"))


def format_coordinate(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2f°%s, %.2f°%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def region_name(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Thirds of the scene by name: upper left to lower right, central in the middle."""
    v = F.when(y < height / 3, "upper").when(y < 2 * height / 3, "central").otherwise("lower")
    h = F.when(x < width / 3, "left").when(x < 2 * width / 3, "central").otherwise("right")
    return F.when((v == "central") & (h == "central"), "central").otherwise(F.concat_ws(" ", v, h))


def georeference(x: Column, y: Column, affine: Column, has_crs: Column) -> Column:
    """(lon, lat) of a pixel by the affine (a, b, c, d, e, f), eight places; null without a reference."""
    px = lambda i, j, k: F.round(affine[i] * x + affine[j] * y + affine[k], 8)
    return F.when(has_crs, F.struct(px(0, 1, 2).alias("lon"), px(3, 4, 5).alias("lat")))


def box_centroid(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(F.round((x_min + x_max) / 2, 3).alias("x"), F.round((y_min + y_max) / 2, 3).alias("y"))


def scene_centroid(raster_lon: Column, raster_lat: Column, corners: Column) -> Column:
    """Middle of the raster's bounds, or else the mean of the footprint's good corners."""
    mean = lambda f: F.aggregate(F.transform(corners, lambda p: p[f]), F.lit(0.0), lambda s, x: s + x) / F.size(corners)
    own = F.when(raster_lon.isNotNull() & raster_lat.isNotNull(), F.struct(raster_lon.alias("lon"), raster_lat.alias("lat")))
    return F.coalesce(own, F.when(F.size(corners) > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))))


def geography(footprint: Column, record_incidence: Column, scene_incidence: Column, orbit: Column, width: Column, height: Column) -> Column:
    """What is known of a scene's place, or null if nothing is. The record's incidence angle goes first."""
    incidence, size = F.coalesce(record_incidence, scene_incidence), F.when(width.isNotNull() & height.isNotNull(), F.array(width, height))
    known = footprint.isNotNull() | incidence.isNotNull() | orbit.isNotNull() | size.isNotNull()
    return F.when(known, F.struct(footprint.alias("footprint"), incidence.alias("incidence_angle_deg"), F.lower(orbit).alias("orbit_direction"), size.alias("raster_px")))
