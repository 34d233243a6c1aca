"""XML of products: manifests, calibration and noise tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

MANIFEST = "name string, familyName string, number string, pass string, startTime string, footprint string, polarisation array<string>"
CALIBRATION = "adsHeader struct<polarisation:string>, calibrationVectorList struct<calibrationVector:array<struct<line:bigint,pixel:string,sigmaNought:string>>>"
NOISE = "adsHeader struct<polarisation:string>, noiseRangeVectorList struct<noiseRangeVector:array<struct<line:bigint,pixel:string,noiseRangeLut:string>>>, noiseAzimuthVectorList struct<noiseAzimuthVector:array<struct<swath:string,firstRangeSample:bigint,lastRangeSample:bigint,line:string,noiseAzimuthLut:string>>>"


def _parsed(rows: DataFrame, key: str, xml: str, schema: str) -> DataFrame:
    """key, x: every document parsed once and written; what is made of it reads that several times."""
    x = rows.select(key, F.from_xml(xml, schema).alias("x"))
    path = shared_path(rows.sparkSession)
    x.write.parquet(path)
    return rows.sparkSession.read.schema(x.schema).parquet(path)


def is_grd(manifest: Column) -> Column:
    return F.contains(manifest, F.lit("productType>GRD"))


def manifest_metadata(rows: DataFrame, key: str = "scene", xml: str = "value") -> DataFrame:
    """Sensor, orbit pass, start, footprint and distinct polarisations of manifests."""
    m = rows.select(key, F.from_xml(xml, MANIFEST).alias("m"))
    return m.select(key, "m.name", F.concat("m.familyName", "m.number").alias("sensor"), F.col("m.pass").alias("orbit_pass"), F.col("m.startTime").alias("start"), "m.footprint", F.array_join(F.array_distinct("m.polarisation"), ",").alias("polarisations"))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))


def _nodes(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """Long form of vectors (line, pixel text, value text), with the reason where a scene's table is refused."""
    v = vectors.withColumn("pixels", _numbers(F.col("v.pixel"))).withColumn("numbers", _numbers(F.col(f"v.{values}"))).withColumn("fits", F.size("pixels") == F.size("numbers"))
    return v.select(key, "pol", F.col("v.line").alias("line"), "pixels", "numbers", "fits")


def _table(nodes: DataFrame, key: str, lowest: float, strict: bool) -> DataFrame:
    low = F.exists("numbers", lambda x: x.isNull() | ((x <= lowest) if strict else (x < lowest)))
    by = nodes.groupBy(key, "pol").agg(F.count_distinct("pixels").alias("grids"), F.bool_and("fits").alias("fits"), F.bool_or(low).alias("low"))
    reason = F.when(~F.col("fits"), "length").when(F.col("grids") > 1, "ragged").when(F.col("low"), "value")
    return nodes.join(by.select(key, "pol", reason.alias("reason")), [key, "pol"])


def calibration_nodes(rows: DataFrame, key: str = "scene", xml: str = "value") -> DataFrame:
    """scene, pol, line, pixel, a: calibration nodes of whole tables; ragged, unequal or non-positive ones are refused."""
    v = _parsed(rows, key, xml, CALIBRATION).select(key, F.col("x.adsHeader.polarisation").alias("pol"), F.explode("x.calibrationVectorList.calibrationVector").alias("v"))
    good = _table(_nodes(v, key, "sigmaNought"), key, 0.0, True).where("reason is null")
    return good.select(key, "pol", "line", F.explode(F.arrays_zip("pixels", "numbers")).alias("n")).select(key, "pol", "line", F.col("n.pixels").cast("bigint").alias("pixel"), F.col("n.numbers").alias("a"))


def noise_nodes(rows: DataFrame, key: str = "scene", xml: str = "value") -> tuple[DataFrame, DataFrame]:
    """Range nodes as for calibration (zero is allowed), and azimuth blocks; malformed blocks are skipped."""
    x = _parsed(rows, key, xml, NOISE).select(key, F.col("x.adsHeader.polarisation").alias("pol"), "x")
    v = x.select(key, "pol", F.explode("x.noiseRangeVectorList.noiseRangeVector").alias("v"))
    good = _table(_nodes(v, key, "noiseRangeLut"), key, 0.0, False).where("reason is null")
    nodes = good.select(key, "pol", "line", F.explode(F.arrays_zip("pixels", "numbers")).alias("n")).select(key, "pol", "line", F.col("n.pixels").cast("bigint").alias("pixel"), F.col("n.numbers").alias("noise"))
    b = x.select(key, "pol", F.posexplode("x.noiseAzimuthVectorList.noiseAzimuthVector").alias("block", "b")).withColumn("lines", _numbers(F.col("b.line"))).withColumn("factors", _numbers(F.col("b.noiseAzimuthLut")))
    whole = b.where((F.size("lines") == F.size("factors")) & (F.col("b.lastRangeSample") >= F.col("b.firstRangeSample")) & F.forall("factors", lambda f: f.isNotNull()))
    return nodes, whole.select(key, "pol", "block", "b.swath", F.col("b.firstRangeSample").alias("first_sample"), F.col("b.lastRangeSample").alias("last_sample"), "lines", "factors")


def incidence_mean(members: DataFrame, archive: str = "archive") -> DataFrame:
    """Mean of all incidence angles of an archive's annotations, two places; calibration and interference tables don't count."""
    own = members.where(F.contains(F.col("name"), F.lit("annotation/")) & ~F.col("name").rlike("annotation/(calibration|rfi)/"))
    angles = own.select(archive, F.explode(F.regexp_extract_all("text", F.lit("<incidenceAngle>([0-9.]+)</incidenceAngle>"), F.lit(1))).alias("a"))
    return angles.groupBy(archive).agg(F.round(F.avg(F.col("a").cast("double")), 2).alias("incidence"))
