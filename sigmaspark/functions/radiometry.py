"""Radiometric expressions: calibrated decibels, display levels, normalised channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
FLOOR_DB = -50.0
DISPLAY_MIN_DB, DISPLAY_MAX_DB = -25.0, 5.0
Z_VV, Z_VH = (-12.64386, 5.13349), (-19.35256, 5.59051)  # mean and deviation
EARTH_KM = 6371.0088


def to_db(power: Column) -> Column:
    return 10.0 * F.log10(power)


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def dn_to_sigma0_db(dn: Column, calibration: Column, noise: Column | None = None, floor_db: float = FLOOR_DB) -> Column:
    """Digital numbers as sigma0 in dB, after taking off the noise power; never below the floor."""
    return to_db(F.greatest((dn * dn - (F.lit(0.0) if noise is None else noise)) / (calibration * calibration), F.lit(10.0 ** (floor_db / 10))))


def linear_to_db(x: Column, floor_db: float = FLOOR_DB) -> Column:
    return to_db(F.greatest(x, F.lit(10.0 ** (floor_db / 10))))


def patch_db(x: Column, radiometry: Column) -> Column:
    """Digital numbers on a plain logarithm, linear sigma0 in dB; an unknown tag means digital numbers."""
    return F.when(radiometry == "sigma0_linear", linear_to_db(x)).otherwise(F.log10(x + 1.0))


def db_to_level(db: Column) -> Column:
    """0 to 255 between the display limits, truncated."""
    share = (F.least(F.greatest(db, F.lit(DISPLAY_MIN_DB)), F.lit(DISPLAY_MAX_DB)) - DISPLAY_MIN_DB) / (DISPLAY_MAX_DB - DISPLAY_MIN_DB)
    return F.floor(share * 255.0).cast("int")


def channels(bands: Column) -> Column:
    """Three display channels of a pixel's bands: one band thrice, two with their difference, three or more clipped."""
    clip = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")
    vv, vh = F.get(bands, F.lit(0)), F.get(bands, F.lit(1))
    two = F.array(db_to_level(vv), db_to_level(vh), db_to_level(vv - vh))
    return F.when(F.size(bands) == 1, F.array(db_to_level(vv), db_to_level(vv), db_to_level(vv))).when(F.size(bands) == 2, two).otherwise(F.transform(F.slice(bands, 1, 3), clip))


def zscore(db: Column, mean_deviation: tuple[float, float]) -> Column:
    return (db - mean_deviation[0]) / mean_deviation[1]
