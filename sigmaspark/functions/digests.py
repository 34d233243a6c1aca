"""Digests in their usual spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_to_hex(c: Column) -> Column:
    return F.lower(F.hex(F.unbase64(c)))


def hex_to_base64(c: Column) -> Column:
    return F.base64(F.unhex(c))
