"""Citations as JSON entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "source_type string, source_id string, provenance map<string,string>"


def parse_citations(rows: DataFrame, entries: str, most: int = 100) -> DataFrame:
    """Rows with ``citations``: the first ``most`` entries that parse and have a type and an id."""
    parsed = F.transform(entries, lambda e: F.from_json(e, SCHEMA))
    good = F.filter(parsed, lambda c: c.isNotNull() & c["source_type"].isNotNull() & c["source_id"].isNotNull())
    return rows.withColumn("citations", F.slice(good, 1, most))
