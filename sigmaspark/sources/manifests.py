"""Embedding manifests (gzip JSON lines) and scene records (one JSON document per scene)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def _checked(rows: DataFrame, dimension: int | None) -> DataFrame:
    if dimension is None:
        return rows
    return rows.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dimension} numbers"))))


def write_manifest(rows: DataFrame, dimension: int | None, path: str | None = None) -> str:
    """Write vectors as gzip JSON lines; returns the folder."""
    path = path or f"{shared_path(rows.sparkSession)}/manifest"
    _checked(rows, dimension).write.option("compression", "gzip").json(path)
    return path


def read_manifest(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    return _checked(spark.read.schema("point_id bigint, vector array<double>").json(path), dimension)


def write_records(records: DataFrame, path: str | None = None, scene: str = "scene", record: str = "record", buckets: int = 64) -> str:
    """Write one JSON document per scene, a line each, in ``buckets`` folders by a hash of the scene; ``read_record`` opens one of them."""
    path = path or f"{shared_path(records.sparkSession)}/records"
    placed = records.select(F.col(scene).alias("scene"), F.col(record).alias("record"), _record_bucket(F.col(scene), buckets).alias("bucket"))
    placed.repartition("bucket").write.partitionBy("bucket").option("ignoreNullFields", "false").json(path)
    return path


def _record_bucket(scene: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scene.cast("string")), F.lit(buckets)).cast("int")


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """scene and record of all scenes; ``record`` is the record's schema."""
    return spark.read.schema(f"scene string, record {record}, bucket int").json(path).drop("bucket")


def read_record(spark: SparkSession, path: str, record: str, scene: str, buckets: int = 64) -> DataFrame:
    """The record of one scene, from its folder alone."""
    rows = spark.read.schema(f"scene string, record {record}, bucket int").json(path)
    bucket = spark.range(1).select(_record_bucket(F.lit(scene), buckets)).first()[0]
    return rows.where((F.col("bucket") == bucket) & (F.col("scene") == scene)).drop("bucket")
