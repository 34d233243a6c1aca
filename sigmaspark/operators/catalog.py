"""Product catalogue: typed rows, contracts, areas of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.radiometry import EARTH_KM
from . import spatial

# Fixed values
NAME_PATTERN = r"^S1[A-D]_IW_GRDH_1SDV_"
PRODUCT_TYPE, CHANNELS = "IW_GRDH_1S", "VV&VH"
MAX_AREA_KM2, MAX_DAYS, MAX_EDGE_PX, PIXEL_M, PIN_SECONDS = 250_000.0, 90, 2500, 10.0, 30
MAX_PRODUCT_BYTES = 2_000_000_000
POLARISATIONS = ["VV", "VH", "HH", "HV"]
PRODUCT_JSON = "Id string, Name string, ContentLength string, Online boolean, ContentDate struct<Start:string,End:string>, GeoFootprint struct<type:string,coordinates:array<array<array<double>>>>, Attributes array<struct<Name:string,Value:string>>"


def odata_timestamp(c: Column) -> Column:
    """Timestamp of an ISO text: Z or no zone is UTC, finer digits than microseconds are cut, else null."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(c), "Z$", "+00:00"), r"(\.\d{6})\d+", "$1")
    return F.coalesce(F.try_to_timestamp(cut), F.try_to_timestamp(F.concat(cut, F.lit("+00:00"))))


def products(lines: DataFrame, json: str = "value") -> DataFrame:
    """Typed rows of catalogue JSON; attributes become a map, missing parts null, online unless stated otherwise."""
    p = lines.select(F.from_json(json, PRODUCT_JSON).alias("p")).where("p.Id is not null and p.Name is not null")
    attrs = F.map_from_entries(F.coalesce(F.col("p.Attributes"), F.array().cast("array<struct<Name:string,Value:string>>")))
    row = p.select("p", attrs.alias("a"))
    return row.select(
        F.col("p.Id").alias("id"), F.regexp_replace("p.Name", r"\.SAFE$", "").alias("name"), F.expr("try_cast(p.ContentLength as bigint)").alias("size_bytes"),
        F.coalesce("p.Online", F.lit(True)).alias("online"), odata_timestamp(F.col("p.ContentDate.Start")).alias("start"),
        F.concat(F.lit("S1"), F.try_element_at("a", F.lit("platformSerialIdentifier"))).alias("platform"), F.try_element_at("a", F.lit("productType")).alias("product_type"),
        F.try_element_at("a", F.lit("polarisationChannels")).alias("channels"), F.try_element_at("a", F.lit("orbitDirection")).alias("orbit"), F.get("p.GeoFootprint.coordinates", F.lit(0)).alias("ring"))


def contract(rows: DataFrame, start: Column, end: Column, most: int | None = None) -> DataFrame:
    """Products that the processing accepts, newest first; offline ones stay visible."""
    kept = rows.where((F.col("product_type") == PRODUCT_TYPE) & (F.col("channels") == CHANNELS) & F.col("start").between(start, end) & F.col("name").rlike(NAME_PATTERN))
    return kept.orderBy(F.desc("start"), "id").limit(most) if most else kept


def usability(requested: Column) -> Column:
    """The first reason why a product can't be used, or null."""
    return (F.when(~F.col("name").rlike(NAME_PATTERN), "name").when(F.coalesce(F.col("product_type"), F.lit("")) != PRODUCT_TYPE, "type").when(F.coalesce(F.col("channels"), F.lit("")) != CHANNELS, "polarisation")
            .when(~F.col("online"), "offline").when(F.col("size_bytes").isNull() | (F.col("size_bytes") <= 0), "size_missing").when(F.col("size_bytes") > MAX_PRODUCT_BYTES, "too_large").when(F.col("name") != requested, "name_changed"))


def product_metadata(rows: DataFrame, keep: list[str]) -> DataFrame:
    """id and a map of the kept fields as text, without nulls."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keep])
    return rows.select("id", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("metadata"))


def polarisations(text: Column) -> Column:
    """Polarisations named in a text, in their usual order; a single Unknown if none is."""
    found = F.filter(F.array(*map(F.lit, POLARISATIONS)), lambda p: F.contains(F.upper(text), p))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unknown")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def extent_km(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Width at the middle latitude, and height."""
    mid = (south + north) / 2
    return haversine_km(mid, west, mid, east), haversine_km(south, west, north, west)


def span_equirect_km(west: Column, south: Column, east: Column, north: Column, radius: float = 6371.0) -> tuple[Column, Column]:
    """Width and height on a plane whose degrees are scaled at the middle latitude."""
    return F.radians(east - west) * F.cos(F.radians((south + north) / 2)) * radius, F.radians(north - south) * radius


def box_reason(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Why an area of interest is refused, or null."""
    w, h = extent_km(west, south, east, north)
    return F.when(east <= west, "east_not_east_of_west").when(north <= south, "north_not_north_of_south").when(w * h > MAX_AREA_KM2, "area_too_large")


def window_reason(start: Column, end: Column) -> Column:
    return F.when(end < start, "end_before_start").when(F.datediff(end, start) > MAX_DAYS, "window_too_long")


def subset_pixels(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Pixels of a subset, rounded up."""
    w, h = span_equirect_km(west, south, east, north)
    return F.ceil(w * 1000 / PIXEL_M).cast("int"), F.ceil(h * 1000 / PIXEL_M).cast("int")


def subset_reason(width: Column, height: Column) -> Column:
    return F.when((width > MAX_EDGE_PX) | (height > MAX_EDGE_PX), "too_large")


def pin_acquisition(wanted: DataFrame, found: DataFrame, key: str, seconds: int = PIN_SECONDS) -> DataFrame:
    """Acquisitions within some seconds of a wanted start, of the same key. Buckets of that length make the join equal."""
    size = 2 * seconds
    w = wanted.withColumn("bucket", F.explode(F.array(*[F.floor((F.unix_seconds("start") + k * size) / size) for k in (-1, 0, 1)])))
    f = found.withColumn("bucket", F.floor(F.unix_seconds("ts") / size))
    return w.join(f, [key, "bucket"]).where(F.abs(F.unix_micros("ts") - F.unix_micros("start")) <= seconds * 1_000_000).drop("bucket")


def boxes_meet(left: DataFrame, right: DataFrame, size: float = 10.0, crowd: int = spatial.CROWD) -> DataFrame:
    """Pairs of (left, right) whose boxes intersect, columns with l_ and r_. They meet in cells of ``size`` degrees, smaller where boxes crowd."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.where("east > west and north > south").select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])

    box = lambda p: (f"{p}_west", f"{p}_south", f"{p}_east", f"{p}_north")
    return spatial.overlapping(side(left, "l"), side(right, "r"), [], box("l"), box("r"), size, crowd)
