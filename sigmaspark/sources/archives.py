"""Product archives: members, magic bytes, safety and layout rules."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 20_000, 20_000_000_000, 100
#: Members that leave a task at a time, but for those of one archive.
AT_ONCE = 10_000
MEMBERS = "archive string, name string, size bigint, compressed bigint, flags int, mode bigint"


def _made(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "name", "size", "compressed", "flags", "mode"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of many archives at a time: a batch for each archive would cost more than reading it."""
    rows: list[tuple] = []
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            try:
                found = zipfile.ZipFile(io.BytesIO(data.as_py())).infolist()
            except (zipfile.BadZipFile, TypeError):
                continue
            key = name.as_py()
            rows += [(key, m.filename, m.file_size, m.compress_size, m.flag_bits, m.external_attr >> 16) for m in found]
            if len(rows) >= AT_ONCE:
                yield _made(rows)
                rows = []
    if rows:
        yield _made(rows)


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row per member of each archive, from rows of the binaryFile source; unreadable archives have none."""
    return files.select(path, content).mapInArrow(_listed, MEMBERS)


def measurements(members: DataFrame) -> DataFrame:
    """The rasters of each archive: those below measurement/, or else any; one or two are usable."""
    tif = members.where(F.lower("name").rlike(r"\.tiff?$"))
    own = F.lower("name").rlike(r"(^|/)measurement/")
    by = tif.groupBy("archive").agg(F.array_sort(F.collect_list(F.when(own, F.col("name")))).alias("m"), F.array_sort(F.collect_list("name")).alias("a"))
    chosen = by.select("archive", F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("a")).alias("rasters"))
    return chosen.withColumn("usable", F.size("rasters").between(1, 2))


def magic_kind(content: Column) -> Column:
    """zip, tiff, json or null by the first bytes."""
    h = F.hex(F.substring(content, 1, 4))
    text = F.regexp_replace(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), "^ï»¿", "")
    return F.when(h.startswith("504B0304") | h.startswith("504B0506"), "zip").when(h.isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff").when(text.rlike(r"^\s*[\{\[]"), "json")


def safety_reason(members: DataFrame) -> DataFrame:
    """Why an archive isn't safe to open, or null."""
    name = F.col("name")
    odd = name.startswith("/") | F.contains(name, F.lit("\\")) | F.contains(name, F.lit(":")) | F.contains(name, F.lit("\0")) | name.rlike(r"(^|/)\.\.(/|$)")
    ratio = (F.col("size") > 0) & ((F.col("compressed") <= 0) | (F.col("size") > MAX_RATIO * F.col("compressed")))
    by = members.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bool_or(odd).alias("odd"), F.bool_or(F.col("flags").bitwiseAND(F.lit(1)) == 1).alias("locked"),
        F.bool_or(F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o120000).alias("link"), F.bool_or(ratio).alias("bomb"), F.bool_or(F.lower(name).endswith("manifest.safe")).alias("manifest"))
    reason = (F.when(F.col("n") > MAX_ENTRIES, "entries").when(F.col("odd"), "path").when(F.col("locked"), "encrypted").when(F.col("link"), "symlink").when(F.col("total") > MAX_BYTES, "size").when(F.col("bomb"), "ratio").when(~F.col("manifest"), "manifest"))
    return by.select("archive", reason.alias("reason"))


def layout_reason(members: DataFrame) -> DataFrame:
    """Why an archive isn't a dual-polarisation product, or null: one manifest, two measurements (VV and VH), tables for both."""
    low = F.lower("name")
    tif = low.rlike(r"(^|/)measurement/.*\.tiff?$")
    vv, vh = F.contains(low, F.lit("-vv-")), F.contains(low, F.lit("-vh-"))
    n = lambda c: F.count_if(c)
    cal, noise = F.contains(low, F.lit("/calibration-")), F.contains(low, F.lit("/noise-"))
    by = members.groupBy("archive").agg(n(low.endswith("manifest.safe")).alias("manifest"), n(tif).alias("tif"), n(tif & (vv == vh)).alias("unclear"), n(tif & vv).alias("vv"), n(tif & vh).alias("vh"),
        *[n(kind & pol).alias(f"{k}_{p}") for k, kind in (("cal", cal), ("noise", noise)) for p, pol in (("vv", vv), ("vh", vh))])
    reason = (F.when(F.col("manifest") != 1, "manifest").when(F.col("tif") != 2, "measurements").when(F.col("unclear") > 0, "unclear_band").when((F.col("vv") != 1) | (F.col("vh") != 1), "bands")
              .when((F.col("cal_vv") == 0) | (F.col("cal_vh") == 0), "calibration").when((F.col("noise_vv") == 0) | (F.col("noise_vh") == 0), "noise"))
    return by.select("archive", reason.alias("reason"))
