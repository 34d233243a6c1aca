"""Work on whole tiles: look-up tables that come to the tiles, filters that exchange borders only.

Tiles (``tiling.to_tiles``: scene, tile_row, tile_col, ``at`` and an array a band) are stored in
buckets of their place. What belongs to a tile is exchanged to its bucket; the tiles stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .scattering import MECHANISMS
from .summaries import few, written

PLACE = ["tile_row", "tile_col"]


def stored(tiles: DataFrame, buckets: int | None = None, scene: str = "scene") -> DataFrame:
    """Tiles written in buckets of (scene, tile_row, tile_col); as many as shuffle partitions, unless stated."""
    spark = tiles.sparkSession
    name = f"tiles_{uuid.uuid4().hex}"
    many = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles.write.bucketBy(many, scene, *PLACE).option("path", f"{shared_path(spark)}/tiles").saveAsTable(name)
    return spark.table(name)


def _values(batch: pa.RecordBatch, column: str, kind: type) -> list[np.ndarray]:
    """The arrays of a list column as views of one buffer; nulls are NaN, or -1 for whole numbers."""
    lists = batch.column(column)
    flat = lists.flatten()
    if flat.null_count:
        flat = flat.fill_null(np.nan if kind is float else -1)
    data = flat.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _listed(arrays: list[np.ndarray], kind: pa.DataType, missing: Callable[[np.ndarray], np.ndarray] | None = None) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind, mask=missing(flat) if missing else None))


def _node_places(nodes: DataFrame, extent: DataFrame, axis: str, tile: int, scene: str) -> DataFrame:
    """scene, line (or pixel), first and last tile that lies between its neighbours; the outer ones reach to the scene's edge."""
    at = "tile_row" if axis == "line" else "tile_col"
    order = Window.partitionBy(scene).orderBy(axis)  # a few hundred lines a scene
    near = nodes.select(scene, axis).distinct().withColumn("before", F.lag(axis).over(order)).withColumn("after", F.lead(axis).over(order))
    low = F.greatest(F.lit(0), F.coalesce(F.floor(F.col("before") / tile), F.lit(0)))
    high = F.least(F.col(f"last_{at}"), F.coalesce(F.floor(F.col("after") / tile), F.col(f"last_{at}")))
    spans = near.join(extent, scene).select(scene, axis, low.cast("int").alias("low"), high.cast("int").alias("high"))
    return spans.where("low <= high").select(scene, axis, F.explode(F.sequence("low", "high")).alias(at))


def bilinear(tiles: DataFrame, nodes: DataFrame, tile: int, scene: str = "scene") -> DataFrame:
    """scene, tile_row, tile_col, at, value: the look-up value at every pixel of a tile, as ``lut.bilinear`` has it.

    Each tile gets the nodes around it; a tile's nodes are few. Stored tiles are not exchanged.
    """
    extent = few(written(tiles.groupBy(scene).agg(*[F.max(p).alias(f"last_{p}") for p in PLACE]), "extent"))
    placed = nodes.join(_node_places(nodes, extent, "line", tile, scene), [scene, "line"]).join(_node_places(nodes, extent, "pixel", tile, scene), [scene, "pixel"])
    own = placed.groupBy(scene, *PLACE).agg(F.collect_list(F.col("line").cast("double")).alias("lines"), F.collect_list(F.col("pixel").cast("double")).alias("pixels"), F.collect_list(F.col("a").cast("double")).alias("values"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = (batch.column(p).to_numpy() * tile for p in PLACE)
            out = []
            for r0, c0, at, lines, pixels, a in zip(rows, cols, *(_values(batch, c, float) for c in ("at", "lines", "pixels", "values")), strict=True):
                ys, i = np.unique(lines, return_inverse=True)
                xs, j = np.unique(pixels, return_inverse=True)
                grid = np.full((len(ys), len(xs)), np.nan)
                grid[i, j] = a
                y, x = np.clip(at // tile + r0, ys[0], ys[-1]), np.clip(at % tile + c0, xs[0], xs[-1])
                k, m = (np.clip(np.searchsorted(s, v, "right") - 1, 0, max(len(s) - 2, 0)) for s, v in ((ys, y), (xs, x)))
                k1, m1 = np.minimum(k + 1, len(ys) - 1), np.minimum(m + 1, len(xs) - 1)
                fy, fx = (y - ys[k]) / np.maximum(ys[k1] - ys[k], 1e-300), (x - xs[m]) / np.maximum(xs[m1] - xs[m], 1e-300)
                top, bottom = grid[k, m] + (grid[k, m1] - grid[k, m]) * fx, grid[k1, m] + (grid[k1, m1] - grid[k1, m]) * fx
                out.append(top + (bottom - top) * fy)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (scene, *PLACE, "at")), _listed(out, pa.float64())], [scene, *PLACE, "at", "value"])

    kind = dict(tiles.dtypes)
    met = tiles.select(scene, *PLACE, "at").join(own, [scene, *PLACE])
    return met.mapInArrow(look_up, f"`{scene}` {kind[scene]}, tile_row int, tile_col int, at {kind['at']}, value array<double>")


def _dense(at: np.ndarray, label: np.ndarray, tile: int) -> np.ndarray:
    out = np.full((tile, tile), -1, np.int8)
    out[at // tile, at % tile] = label
    return out


def majority_filter(tiles: DataFrame, tile: int, scene: str = "scene") -> DataFrame:
    """scene, tile_row, tile_col, at, label: the most frequent label around each cell, as ``mechmap.majority_filter`` has it.

    A tile sends its border to the eight tiles around it, at most 4 * ``tile`` + 4 labels; its cells stay.
    """
    kind = dict(tiles.dtypes)
    last = [F.max(F.array_max(F.transform("at", f)) + F.col(p) * tile).alias(n) for f, p, n in ((lambda x: F.floor(x / tile), "tile_row", "rows"), (lambda x: x % tile, "tile_col", "cols"))]
    extent = few(written(tiles.groupBy(scene).agg(*last), "extent"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, to_row, to_col, side, sent = [], [], [], [], []
            for n, (r, c, at, label) in enumerate(zip(batch.column("tile_row").to_pylist(), batch.column("tile_col").to_pylist(), _values(batch, "at", int), _values(batch, "label", int), strict=True)):
                own = _dense(at, label, tile)
                edge = {-1: slice(0, 1), 0: slice(None), 1: slice(tile - 1, tile)}
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        strip = own[edge[dr], edge[dc]].ravel()
                        if (dr or dc) and r + dr >= 0 and c + dc >= 0 and (strip >= 0).any():
                            whose.append(n)
                            to_row.append(r + dr)
                            to_col.append(c + dc)
                            side.append(3 * (1 - dr) + 1 - dc)  # as the receiver sees it
                            sent.append(strip.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(scene).take(pa.array(whose, pa.int64())), pa.array(to_row, pa.int32()), pa.array(to_col, pa.int32()), pa.array(side, pa.int32()), pa.array(sent, pa.binary())], [scene, *PLACE, "side", "strip"])

    halo = tiles.select(scene, *PLACE, "at", "label").mapInArrow(borders, f"`{scene}` {kind[scene]}, tile_row int, tile_col int, side int, strip binary").groupBy(scene, *PLACE).agg(F.collect_list(F.struct("side", "strip")).alias("halo"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, c, rows, cols, halo_, at, label in zip(*(batch.column(x).to_pylist() for x in (*PLACE, "rows", "cols", "halo")), _values(batch, "at", int), _values(batch, "label", int), strict=True):
                wide = np.full((tile + 2, tile + 2), -1, np.int8)
                wide[1:-1, 1:-1] = _dense(at, label, tile)
                edge = {0: slice(0, 1), 1: slice(1, tile + 1), 2: slice(tile + 1, tile + 2)}
                for h in halo_ or []:
                    place = wide[edge[h["side"] // 3], edge[h["side"] % 3]]
                    place[...] = np.frombuffer(h["strip"], np.int8).reshape(place.shape)
                # beyond the scene's edge the edge's cells are repeated
                i, j = (np.clip(np.arange(-1, tile + 1) + t * tile, 0, n) - t * tile + 1 for t, n in ((r, rows), (c, cols)))
                wide = wide[np.clip(i, 0, tile + 1)][:, np.clip(j, 0, tile + 1)]
                votes = np.stack([sum((wide[a : a + tile, b : b + tile] == k).astype(np.int8) for a in range(3) for b in range(3)) for k in range(len(MECHANISMS))])
                best = votes.argmax(0)[at // tile, at % tile]
                out.append(np.where(label >= 0, best, -1))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (scene, *PLACE, "at")), _listed(out, pa.int32(), lambda x: x < 0)], [scene, *PLACE, "at", "label"])

    met = tiles.select(scene, *PLACE, "at", "label").join(halo, [scene, *PLACE], "left").join(extent, scene)
    return met.mapInArrow(vote, f"`{scene}` {kind[scene]}, tile_row int, tile_col int, at {kind['at']}, label array<int>")


def to_cells(tiles: DataFrame, tile: int, values: list[str], row: str = "r", col: str = "c", scene: str = "scene") -> DataFrame:
    """A row per cell again: scene, row, column and the values."""
    each = tiles.select(scene, *PLACE, F.explode(F.arrays_zip("at", *values)).alias("x"))
    return each.select(scene, (F.col("tile_row") * tile + F.floor(F.col("x.at") / tile)).cast("int").alias(row), (F.col("tile_col") * tile + F.col("x.at") % tile).cast("int").alias(col), *[f"x.{v}" for v in values])
