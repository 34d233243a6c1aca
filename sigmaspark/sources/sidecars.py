"""JSON sidecars of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sidecar_metadata(rows: DataFrame, key: str = "scene", json: str = "value") -> DataFrame:
    """sensor, acquired and polarisations of a sidecar: STAC properties, or else top-level fields; unreadable ones give nulls."""
    v = F.try_parse_json(json)
    text = lambda path: F.try_variant_get(v, path, "string")
    pols = F.coalesce(F.try_variant_get(v, "$.properties['sar:polarizations']", "array<string>"), F.split(text("$.polarization"), "[,&/]"))
    return rows.select(key, F.coalesce(text("$.properties.platform"), text("$.sensor")).alias("sensor"), text("$.properties.datetime").alias("acquired"), pols.alias("polarisations"))
