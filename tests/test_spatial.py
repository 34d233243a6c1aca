"""Boxes in crowded cells, suppression against the greedy rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.operators import catalog, detections, spatial
from sigmaspark.session import shared_path

BOX = "scene string, label string, id long, confidence double, x_min double, y_min double, x_max double, y_max double"
XY = ("x_min", "y_min", "x_max", "y_max")


def drawn(seed, n, width, size, scene="s"):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w, h = r.uniform(-width, width), r.uniform(0, width), r.choice(size) * r.uniform(0.5, 1), r.choice(size) * r.uniform(0.5, 1)
        out.append((scene, r.choice("ab"), k, r.randint(0, 50) / 50, x, y, x + w, y + h))
    return out


def by_hand(rows):
    """All (better, worse) above 0.5, and the greedy winner of each (scene, label, id)."""
    order = sorted(rows, key=lambda b: (-b[3], b[2]))
    pairs, kept, won = set(), [], {}
    for k, b in enumerate(order):
        over = []
        for a in order[:k]:
            if a[:2] == b[:2]:
                w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
                if w > 0 and h > 0 and w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h) > 0.5:
                    over.append(a)
                    pairs.add((b[0], b[1], a[2], b[2]))
        best = [a for a in over if a in kept]
        won[b[:3]] = best[0][2] if best else None
        if not best:
            kept.append(b)
    return pairs, won


@pytest.mark.parametrize("crowd", [5, 100_000])
def test_pairs_and_suppression(spark, crowd):
    rows = drawn(1, 250, 40, [3, 9, 30]) + drawn(2, 150, 40, [3, 9, 30], "t")  # ids repeat between scenes
    df = spark.createDataFrame(rows, BOX)
    pairs, won = by_hand(rows)
    assert {tuple(r)[:4] for r in detections.iou_pairs(df, crowd=crowd).select("scene", "label", "better", "worse").collect()} == pairs
    for one_pass in (0, 50_000):
        got = detections.suppress(df, one_pass=one_pass)
        assert {(r.scene, r.label, r.id): r.winner for r in got.collect()} == won


def test_one_crowded_cell(spark):
    """100 000 boxes in one cell of 64: no cell holds more than a small share of them, and no pair is lost."""
    n = 100_000
    r = lambda k: F.rand(k)
    df = spark.range(n).select(F.lit("s").alias("scene"), F.lit("a").alias("label"), F.col("id"), (10 * r(3)).alias("confidence"), (60 * r(1)).alias("x_min"), (60 * r(2)).alias("y_min"))
    df = df.withColumns({"x_max": F.col("x_min") + 0.05, "y_max": F.col("y_min") + 0.05})
    split, rounds = spatial.crowded_cells([(df, XY)], ["scene", "label"], 64.0)
    placed = spatial.in_cells(df, ["scene", "label"], XY, split, rounds, 64.0)
    count, most = placed.groupBy(*spatial.CELL).count().agg(F.sum("count"), F.max("count")).first()
    assert count < 1.1 * n and most <= 1.5 * spatial.CROWD
    x = df.select("id", *XY).toPandas().sort_values("x_min").to_numpy()
    want, start = 0, 0
    for k in range(0, n, 500):  # a sweep
        own = x[k : k + 500]
        while x[start][3] < own[0][1]:
            start += 1
        near = x[start : np.searchsorted(x[:, 1], own[-1][1], "right")]
        w = np.minimum(own[:, None, 3], near[None, :, 3]) - np.maximum(own[:, None, 1], near[None, :, 1])
        h = np.minimum(own[:, None, 4], near[None, :, 4]) - np.maximum(own[:, None, 2], near[None, :, 2])
        inner = np.maximum(w, 0) * np.maximum(h, 0)
        want += int(((inner / (0.005 - inner) > 0.5) & (own[:, None, 1] > near[None, :, 1])).sum())
    assert abs(detections.iou_pairs(df).count() - want) <= 2  # areas are rounded differently


def test_boxes_that_touch_edges(spark):
    """Boxes on cell borders, points, one over everything, empty tables."""
    rows = [(k, float(a), float(b), float(a + w), float(b + w)) for k, (a, b, w) in enumerate([(0, 0, 10), (10, 10, 10), (-10, -10, 5), (20, 0, 10), (-100, -100, 300), (10, 0, 0.5)] + [(k % 7, k // 7, 0.25) for k in range(49)])]
    df = spark.createDataFrame(rows, "box long, west double, south double, east double, north double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    for crowd in (2, 1000):
        assert sorted((r.l_box, r.r_box) for r in catalog.boxes_meet(df, df, crowd=crowd).collect()) == want
    assert catalog.boxes_meet(df.limit(0), df).count() == 0


def test_cells_are_not_broadcast(spark):
    """Few boxes in many cells each: the side that is sent to all would be many times its estimated size."""
    path = shared_path(spark)
    spark.createDataFrame(drawn(3, 30, 40, [500]), BOX).write.parquet(path)
    df = spark.read.parquet(path)  # its size is known
    plan = detections.iou_pairs(df)._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line and "gx" in line]
    assert met and all("SortMergeJoin" in line for line in met)
