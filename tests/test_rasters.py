"""Tiles that stay where they are: plans, edges, gaps."""

import random
import re

from sigmaspark.operators import lut, mechmap, rasters, tiling


def scans_below_exchanges(df, table):
    """How many scans of ``table`` lie below an exchange of the plan."""
    depth = lambda s: len(re.match(r"[\s:|+\-]*", s)[0])
    found = 0
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for n, line in enumerate(plan):
        if "FileScan" in line and table in line:
            at, above = depth(line), []
            for other in reversed(plan[:n]):
                if depth(other) < at:
                    at = depth(other)
                    above.append(other)
            found += any("Exchange" in x and "Broadcast" not in x for x in above)
    return found


def cells(seed, rows, cols, gaps):
    r = random.Random(seed)
    return [(s, a, b, r.choice([0, 1, 2, 3, 3, None])) for s in ("s", "t") for a in range(rows) for b in range(cols) if r.random() >= gaps]


def test_majority_over_tiles(spark):
    for tile, rows, cols, gaps in ((4, 13, 9, 0.2), (8, 8, 8, 0.0), (5, 3, 2, 0.0)):
        df = spark.createDataFrame(cells(rows, rows, cols, gaps), "scene string, cell_row int, cell_col int, label int")
        tiles = rasters.stored(tiling.to_tiles(df, tile, ["label"], r="cell_row", c="cell_col"), 4)
        got = rasters.to_cells(rasters.majority_filter(tiles, tile), tile, ["label"], "cell_row", "cell_col")
        want = mechmap.majority_filter(df)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_look_up_without_exchange_of_tiles(spark):
    pixels = spark.createDataFrame([(s, r, c, 1.0) for s in ("s", "t") for r in range(37) for c in range(21)], "scene string, r int, c int, dn double")
    nodes = spark.createDataFrame([(s, line, pixel, float(line * 3 + pixel * 2 + (s == "t"))) for s in ("s", "t") for line in (5, 6, 20, 90) for pixel in (-4, 0, 11, 18)], "scene string, line long, pixel long, a double")
    tiles = rasters.stored(tiling.to_tiles(pixels, 8, ["dn"]), 4)
    out = rasters.bilinear(tiles, nodes, 8)
    key = lambda df: sorted((x.scene, x.r, x.c, round(x.value, 9)) for x in df.collect())
    assert key(rasters.to_cells(out, 8, ["value"])) == key(lut.bilinear(pixels, nodes))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert scans_below_exchanges(rasters.bilinear(tiles, nodes, 8), "tiles_") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
