"""Patches of scenes: where they lie, their names, their pixels, overviews."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
PATCH, STRIDE, COVER = 224, 112, 120
#: Patches that a task puts together at a time.
PATCHES_AT_ONCE = 64
SPLIT_EDGE = 8192
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
OVERVIEW_EDGE, PREVIEWS = 1792, 128


def patch_plan(scenes: DataFrame, width: str = "width", height: str = "height", patch: int = PATCH, stride: int = STRIDE) -> DataFrame:
    """A row per whole patch: row_start and col_start; incomplete ones at the edges are dropped."""
    starts = lambda n: F.when(F.col(n) >= patch, F.sequence(F.lit(0), F.floor((F.col(n) - patch) / stride).cast("int") * stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return scenes.withColumn("row_start", F.explode(starts(height))).withColumn("col_start", F.explode(starts(width)))


def planned_patches(width: Column, height: Column, patch: int = PATCH, stride: int = STRIDE) -> Column:
    steps = lambda n: F.when(n >= patch, F.floor((n - patch) / stride) + 1).otherwise(0)
    return steps(width) * steps(height)


def grid_origins(scenes: DataFrame, most: int, size: int = COVER, width: str = "width", height: str = "height") -> DataFrame:
    """A row per evenly spread window of ``size``, about ``most`` of them."""
    cols = F.greatest(F.lit(1), F.bround(F.sqrt(most * F.col(width) / F.col(height)), 0).cast("int"))
    rows = F.greatest(F.lit(1), F.bround(most / cols, 0).cast("int"))
    spread = lambda n, last: F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor(k * last / F.greatest(n - 1, F.lit(1))).cast("int")))
    large = scenes.where((F.col(width) >= size) & (F.col(height) >= size))
    return large.withColumn("row_off", F.explode(spread(rows, F.col(height) - size))).withColumn("col_off", F.explode(spread(cols, F.col(width) - size)))


def patch_uuid(scene: Column, model: str, version: str, row: Column, col: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a patch."""
    name = F.concat_ws(":", scene, F.lit(model), F.lit(version), row, col, F.lit(PATCH))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def quadrant_label(row: Column, col: Column, width: Column, height: Column, patch: int = PATCH) -> Column:
    mid_row, mid_col = row + patch // 2, col + patch // 2
    north, west = mid_row < F.floor(height / 2), mid_col < F.floor(width / 2)
    name = F.concat(F.when(north, "north").otherwise("south"), F.when(west, "west").otherwise("east"), F.lit(" quadrant"))
    split = (width > SPLIT_EDGE) | (height > SPLIT_EDGE)
    return F.concat(F.when(split, name).otherwise("full scene"), F.format_string(", rows %d-%d, columns %d-%d", row, row + patch, col, col + patch))


def preview_cap(patches: DataFrame, scene: str = "scene", most: int = PREVIEWS) -> DataFrame:
    """The first patches of each scene in scan order, which get a preview."""
    order = Window.partitionBy(scene).orderBy("row_start", "col_start")
    return patches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def overview(pixels: DataFrame, height: int, width: int, value: str, longest: int = OVERVIEW_EDGE, scene: str = "scene", r: str = "r", c: str = "c") -> DataFrame:
    """Average of the pixels under each overview pixel; the longest edge keeps to the limit, the aspect is kept."""
    scale = min(1.0, longest / max(height, width))
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return pixels.groupBy(scene, F.floor(F.col(r) * h / height).cast("int").alias("out_row"), F.floor(F.col(c) * w / width).cast("int").alias("out_col")).agg(F.avg(value).alias("mean"))


def crop_window(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column, size: int = PATCH) -> Column:
    """Window of ``size`` around a box, moved inside the scene; null where the scene is smaller."""
    at = lambda lo, hi, n: F.least(F.greatest(F.floor((lo + hi) / 2).cast("int") - size // 2, F.lit(0)), n - size)
    return F.when((width >= size) & (height >= size), F.struct(at(y_min, y_max, height).alias("row_off"), at(x_min, x_max, width).alias("col_off")))


def to_tiles(pixels: DataFrame, tile: int, bands: list[str], scene: str = "scene", r: str = "r", c: str = "c") -> DataFrame:
    """Tile form of pixel rows: an array per band, row-major, a row per (scene, tile_row, tile_col)."""
    at = ((F.col(r) % tile) * tile + F.col(c) % tile).alias("at")
    own = pixels.select(scene, F.floor(F.col(r) / tile).cast("int").alias("tile_row"), F.floor(F.col(c) / tile).cast("int").alias("tile_col"), F.struct(at, *bands).alias("x"))
    return own.groupBy(scene, "tile_row", "tile_col").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(scene, "tile_row", "tile_col", "xs.at", *[F.col(f"xs.{b}").alias(b) for b in bands])


def extract_patches(tiles: DataFrame, plan: DataFrame, tile: int, patch: int, bands: list[str], scene: str = "scene", max_nodata: float = 0.40) -> DataFrame:
    """Patches put together from the tiles they touch: scene, row_start, col_start, patch (band-major floats), nodata_fraction.

    Tiles, not pixels, are exchanged: each is sent once to every patch that it touches, and
    a patch has a bounded number of tiles. Patches with too many zero samples are dropped. Values stay in
    Arrow's buffers: no Python object is made for a pixel.
    """
    span = lambda s: F.sequence(F.floor(F.col(s) / tile).cast("int"), F.floor((F.col(s) + (patch - 1)) / tile).cast("int"))
    wanted = plan.select(scene, "row_start", "col_start").withColumn("tile_row", F.explode(span("row_start"))).withColumn("tile_col", F.explode(span("col_start")))
    pieces = wanted.join(tiles, [scene, "tile_row", "tile_col"]).groupBy(scene, "row_start", "col_start").agg(F.collect_list(F.struct("tile_row", "tile_col", "at", *bands)).alias("pieces"))

    def views(lists: pa.ListArray) -> list[np.ndarray]:
        flat = lists.flatten()
        data = (flat.fill_null(np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return [data[x:y] for x, y in zip(starts, starts[1:], strict=False)]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("pieces")
            parts = dict(zip((f.name for f in held.type.value_type), held.flatten().flatten(), strict=True))
            rows, cols = (parts[p].to_numpy() * tile for p in ("tile_row", "tile_col"))
            ats, values = views(parts["at"]), [views(parts[b]) for b in bands]
            ends = held.offsets.to_numpy() - held.offsets[0].as_py()
            starts = [batch.column(k).to_numpy() for k in ("row_start", "col_start")]
            for first in range(0, batch.num_rows, PATCHES_AT_ONCE):
                part = batch.slice(first, PATCHES_AT_ONCE)
                images = np.zeros((part.num_rows, len(bands), patch, patch), np.float32)
                for n in range(part.num_rows):
                    row_start, col_start = (s[first + n] for s in starts)
                    for p in range(ends[first + n], ends[first + n + 1]):
                        r, c = ats[p] // tile + rows[p] - row_start, ats[p] % tile + cols[p] - col_start
                        inside = (r >= 0) & (r < patch) & (c >= 0) & (c < patch)
                        for k in range(len(bands)):
                            images[n, k, r[inside], c[inside]] = values[k][p][inside]
                size = len(bands) * patch * patch
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size), pa.array(images.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(scene), part.column("row_start"), part.column("col_start"), flat, pa.array((images == 0).mean(axis=(1, 2, 3)))], [scene, "row_start", "col_start", "patch", "nodata_fraction"])

    return pieces.mapInArrow(assemble, f"{scene} string, row_start int, col_start int, patch array<float>, nodata_fraction double").where(F.col("nodata_fraction") <= max_nodata)
