"""Queries of the measuring operators: radiometry, scattering, maps, context, tiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import radiometry as rad
from ..operators import context, lut, mechmap, rasters, scattering, tiling
from . import fixtures as fx
from .fixtures import KEYS, rounded
from .registry import VIEWS, query


def _windows(spark, d) -> DataFrame:
    return scattering.window_summary(fx.windowed(fx.sigma(spark, d)), KEYS)


@query("x01_dn_to_sigma0_db", "SELECT scene, r, c, round(vv_db, 6) AS vv_db, round(vh_db, 6) AS vh_db FROM sigma", "sigma")
def x01(spark, d):
    return rounded(fx.sigma(spark, d))


@query("x02_linear_to_db", "SELECT event_id, round(10 * log10(greatest(coalesce(value, 0) / 100, 1e-5)), 6) AS db FROM events")
def x02(spark, d):
    return rounded(fx.read(spark, d, "events").select("event_id", rad.linear_to_db(F.coalesce("value", F.lit(0.0)) / 100).alias("db")))


@query("x03_patch_db", "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 10 * log10(greatest(coalesce(value, 0), 1e-5)) ELSE log10(coalesce(value, 0) + 1) END, 6) AS db FROM events")
def x03(spark, d):
    e = fx.read(spark, d, "events").withColumn("radiometry", F.when(F.col("event_id") % 2 == 0, "sigma0_linear"))
    return rounded(e.select("event_id", rad.patch_db(F.coalesce("value", F.lit(0.0)), F.col("radiometry")).alias("db")))


@query("x04_db_to_uint8", "SELECT scene, r, c, floor((least(greatest(round(vv_db, 6), -25), 5) + 25) / 30 * 255)::INT AS level FROM sigma", "sigma")
def x04(spark, d):
    return fx.sigma(spark, d).select("scene", "r", "c", rad.db_to_level(F.round("vv_db", 6)).alias("level"))


@query("x05_channels", """SELECT scene, r, c, floor((least(greatest(vv, -25), 5) + 25) / 30 * 255)::INT AS red, floor((least(greatest(vh, -25), 5) + 25) / 30 * 255)::INT AS green,
    floor((least(greatest(vv - vh, -25), 5) + 25) / 30 * 255)::INT AS blue FROM (SELECT scene, r, c, round(vv_db, 6) AS vv, round(vh_db, 6) AS vh FROM sigma)""", "sigma")
def x05(spark, d):
    p = fx.sigma(spark, d).withColumn("rgb", rad.channels(F.array(F.round("vv_db", 6), F.round("vh_db", 6))))
    return p.select("scene", "r", "c", *[F.col("rgb")[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query("x11_zscore_bands", "SELECT scene, r, c, round((vv_db + 12.64386) / 5.13349, 6) AS z_vv, round((vh_db + 19.35256) / 5.59051, 6) AS z_vh FROM sigma", "sigma")
def x11(spark, d):
    return rounded(fx.sigma(spark, d).select("scene", "r", "c", rad.zscore(F.col("vv_db"), rad.Z_VV).alias("z_vv"), rad.zscore(F.col("vh_db"), rad.Z_VH).alias("z_vh")))


@query("f09_nodata_discard", "SELECT scene, wr, wc, round(z, 6) AS nodata_fraction FROM (SELECT scene, r // 5 AS wr, c // 5 AS wc, sum((dn_vv = 0)::INT + (dn_vh = 0)::INT) / (2 * count(*)) AS z FROM pixels GROUP BY ALL) WHERE z <= 0.4", "pixels")
def f09(spark, d):
    return rounded(scattering.nodata_discard(fx.windowed(fx.pixels(spark, d)), KEYS, ["dn_vv", "dn_vh"]))


@query("a01_window_summary", "SELECT scene, wr, wc, round(vv_db, 6) AS vv_db, round(vh_db, 6) AS vh_db, round(ratio_db, 6) AS ratio_db, round(rvi, 6) AS rvi, round(noise_limited_fraction, 6) AS noise_limited_fraction FROM windows", "windows")
def a01(spark, d):
    return rounded(_windows(spark, d))


@query("f10_noise_limited_filter", "SELECT scene, wr, wc, round(vv_db, 6) AS vv_db FROM windows WHERE noise_limited_fraction <= 0.5", "windows")
def f10(spark, d):
    return rounded(_windows(spark, d).where(F.col("noise_limited_fraction") <= scattering.MAX_NOISE_LIMITED).select(*KEYS, "vv_db"))


@query("a02_otsu", "SELECT scene, round(otsu, 6) AS otsu FROM ratio_otsu", "ratio_otsu")
def a02(spark, d):
    return rounded(scattering.otsu(_windows(spark, d), "scene", "ratio_db"))


_T = "round(water_max_vv_db, 6) AS water_max_vv_db, round(water_max_ratio_db, 6) AS water_max_ratio_db"


@query("a03_fit_thresholds", f"SELECT scene, windows::BIGINT AS windows, {_T}, urban_min_vv_db::DOUBLE AS urban_min_vv_db, urban_max_ratio_db::DOUBLE AS urban_max_ratio_db, volume_min_rvi::DOUBLE AS volume_min_rvi, source, reason FROM thresholds", "thresholds")
def a03(spark, d):
    return rounded(scattering.fit_thresholds(_windows(spark, d)))


@query("a04_degenerate_check", "SELECT scene, source, reason FROM thresholds", "thresholds")
def a04(spark, d):
    return scattering.fit_thresholds(_windows(spark, d)).select("scene", "source", "reason")


@query("x10_classify_mechanism", "SELECT scene, wr, wc, mechanism FROM classified", "classified")
def x10(spark, d):
    w = _windows(spark, d)
    return scattering.classify(w, scattering.fit_thresholds(w)).select(*KEYS, "mechanism")


VIEWS["block"] = """SELECT scene, source, mechanism, sum(n) OVER (PARTITION BY scene) AS windows_scored, sum(lost) OVER (PARTITION BY scene) AS windows_discarded, n / sum(n) OVER (PARTITION BY scene) AS fraction, vv, ratio, n FROM (
    SELECT scene, source, mechanism, count(*) FILTER (noise_limited_fraction <= 0.5) AS n, count(*) FILTER (noise_limited_fraction > 0.5) AS lost,
        quantile_cont(vv_db, 0.5) FILTER (noise_limited_fraction <= 0.5) AS vv, quantile_cont(ratio_db, 0.5) FILTER (noise_limited_fraction <= 0.5) AS ratio FROM classified GROUP BY ALL)"""


@query("a05_mechanism_block", "SELECT scene, source, mechanism, windows_scored::BIGINT AS windows_scored, windows_discarded::BIGINT AS windows_discarded, round(fraction, 6) AS fraction, round(vv, 6) AS median_vv_db, round(ratio, 6) AS median_ratio_db FROM block WHERE n > 0", "block")
def a05(spark, d):
    return rounded(scattering.mechanism_block(_windows(spark, d)))


def _line_windows(spark, d) -> DataFrame:
    """Windows at volume: one per order, from its lines."""
    line = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("w"), F.pow(F.col("l_extendedprice").cast("double") / 210000, F.lit(2.0)).alias("vv"), (F.greatest(F.col("l_discount").cast("double"), F.lit(0.001)) * 5).alias("g"))
    power = line.groupBy("w").agg(F.avg("vv").alias("vv"), F.avg(F.col("vv") * F.col("g")).alias("vh")).withColumn("noise_limited_fraction", F.lit(0.0)).withColumn("scene", F.lit("orders"))
    return scattering.summarise_power(power, ["scene", "w"])


VIEWS["line_windows"] = """SELECT 'orders' AS scene, w, 10 * log10(greatest(vv, 1e-5)) AS vv_db, 10 * log10(greatest(vh, 1e-5)) - 10 * log10(greatest(vv, 1e-5)) AS ratio_db, 4 * vh / (vv + vh) AS rvi FROM (
    SELECT l_orderkey AS w, avg(pow(l_extendedprice::DOUBLE / 210000, 2)) AS vv, avg(pow(l_extendedprice::DOUBLE / 210000, 2) * (greatest(l_discount::DOUBLE, 0.001) * 5)) AS vh FROM lineitem GROUP BY l_orderkey)"""


def _of_lines(view: str) -> str:
    """A view over windows, read from the windows of the orders instead."""
    for name in ("windows", "ratio_otsu", "thresholds", "classified"):
        view = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 line_{name}", view)
    return view


VIEWS["line_windows"] = VIEWS["line_windows"].replace("AS rvi FROM (", "AS rvi, 0.0::DOUBLE AS noise_limited_fraction FROM (")
fx.otsu_view("line_ratio_otsu", "line_windows", "ratio_db")
for _name in ("thresholds", "classified", "block"):
    VIEWS[f"line_{_name}"] = _of_lines(VIEWS[_name])


@query("a05_mechanism_block_orders", """SELECT scene, source, mechanism, windows_scored::BIGINT AS windows_scored, windows_discarded::BIGINT AS windows_discarded,
    round(fraction, 6) AS fraction, round(vv, 6) AS median_vv_db, round(ratio, 6) AS median_ratio_db FROM line_block WHERE n > 0""", "line_block")
def a05_orders(spark, d):
    return rounded(scattering.mechanism_block(_line_windows(spark, d)))


@query("a01_window_summary_orders", "SELECT w, round(vv_db, 6) AS vv_db, round(ratio_db, 6) AS ratio_db, round(rvi, 6) AS rvi FROM line_windows", "line_windows")
def a01_orders(spark, d):
    return rounded(_line_windows(spark, d).select("w", "vv_db", "ratio_db", "rvi"))


# -- maps ---------------------------------------------------------------------------

def _cells(spark, d) -> DataFrame:
    p = fx.pixels(spark, d).select("scene", "r", "c", *[(F.col(f"dn_{b}") * F.col(f"dn_{b}") / fx.A2).alias(b) for b in ("vv", "vh")])
    rows = p.agg(F.max("r")).first()[0] or 0
    return mechmap.block_mean_grid(p, 5, rows + 5, 100)


def _label_cells(spark, d) -> DataFrame:
    return mechmap.label_cells(_cells(spark, d), scattering.fit_thresholds(_windows(spark, d)))


@query("a06_block_mean_grid", "SELECT scene, cell_row, cell_col, valid, pixels, round(vv, 6) AS vv, round(vh, 6) AS vh FROM cells", "cells")
def a06(spark, d):
    return rounded(_cells(spark, d))


@query("f11_cell_coverage_mask", "SELECT scene, cell_row, cell_col, valid / pixels >= 0.5 AS usable FROM cells", "cells")
def f11(spark, d):
    return _cells(spark, d).select("scene", "cell_row", "cell_col", mechmap.covered(F.col("valid"), F.col("pixels")).alias("usable"))


@query("j11_neighbour_join", "SELECT scene, cell_row, cell_col, near_cell_row, near_cell_col, near_label::INT AS near_label FROM near_labels", "near_labels")
def j11(spark, d):
    return mechmap.neighbours(_label_cells(spark, d)).select("scene", "cell_row", "cell_col", "near_cell_row", "near_cell_col", "near_label")


@query("a07_majority_filter", "SELECT scene, cell_row, cell_col, label::INT AS label FROM filtered", "filtered")
def a07(spark, d):
    return mechmap.majority_filter(_label_cells(spark, d))


@query("a07_majority_tiles", "SELECT scene, cell_row, cell_col, label::INT AS label FROM filtered", "filtered")
def a07_tiles(spark, d):
    tiles = rasters.stored(tiling.to_tiles(_label_cells(spark, d), 8, ["label"], r="cell_row", c="cell_col"))
    return rasters.to_cells(rasters.majority_filter(tiles, 8), 8, ["label"], "cell_row", "cell_col")


_SHARES = ", ".join(f"round(coalesce(avg((label = {k})::INT) FILTER (label IS NOT NULL), 0), 6) AS {m}" for k, m in enumerate(scattering.MECHANISMS))


@query("a08_map_fractions", f"SELECT scene, {_SHARES}, round(avg((label IS NOT NULL)::INT), 6) AS valid_fraction FROM filtered GROUP BY scene", "filtered")
def a08(spark, d):
    return rounded(mechmap.map_fractions(mechmap.majority_filter(_label_cells(spark, d))))


@query("a09_adopt_map_fractions", """SELECT scene, mechanism, round(f, 6) AS fraction, 'dense_map' AS fraction_source FROM (
    SELECT b.scene, b.mechanism, (SELECT avg((label = list_position(['smooth_surface', 'double_bounce', 'volume', 'rough_surface'], b.mechanism) - 1)::INT) FROM filtered f WHERE f.scene = b.scene AND label IS NOT NULL) AS f FROM block b WHERE n > 0) WHERE f > 0""", "filtered block")
def a09(spark, d):
    fractions = mechmap.map_fractions(mechmap.majority_filter(_label_cells(spark, d)))
    return rounded(mechmap.adopt_map_fractions(scattering.mechanism_block(_windows(spark, d)), fractions))


@query("x08_ground_sampling", "SELECT box, round(CASE WHEN box % 5 = 0 THEN 10 WHEN box % 2 = 0 THEN 0.0001 * 111320 * greatest(cos(radians(south)), 1e-6) ELSE 20 END, 6) AS metres FROM boxes", "boxes")
def x08(spark, d):
    b = fx.boxes(spark, d).withColumn("px", F.when(F.col("box") % 5 != 0, F.when(F.col("box") % 2 == 0, 0.0001).otherwise(20.0)))
    return rounded(b.select("box", mechmap.ground_sampling(F.col("px"), F.col("box") % 2 == 0, F.col("south")).alias("metres")))


@query("x09_block_factor", "SELECT scene, greatest(round_even(60.0 / greatest((width % 40)::DOUBLE, 0.1), 0)::INT, floor(width / 100)::INT, 1) AS block FROM scenes_sized", "scenes_sized")
def x09(spark, d):
    return fx.scenes_sized(spark, d).select("scene", mechmap.block_factor((F.col("width") % 40).cast("double"), F.col("width"), 100).alias("block"))


@query("n08_map_descriptor", """SELECT scene, (max(cell_col) + 1)::INT AS width, (max(cell_row) + 1)::INT AS height, 5 AS block, 25 AS looks, 50.0::DOUBLE AS sampling_m, round(avg((label IS NOT NULL)::INT), 6) AS valid_fraction, 'map' AS geometry,
    'smooth_surface,double_bounce,volume,rough_surface' AS legend FROM filtered GROUP BY scene""", "filtered")
def n08(spark, d):
    cells = mechmap.majority_filter(_label_cells(spark, d))
    return rounded(cells.groupBy("scene").agg((F.max("cell_col") + 1).alias("width"), (F.max("cell_row") + 1).alias("height"), F.lit(5).alias("block"), F.lit(25).alias("looks"), F.lit(50.0).alias("sampling_m"),
        F.avg(F.col("label").isNotNull().cast("double")).alias("valid_fraction"), F.lit("map").alias("geometry"), F.lit(",".join(scattering.MECHANISMS)).alias("legend")))


# -- context ------------------------------------------------------------------------

VIEWS["mag_db"] = "SELECT scene, 10 * log10(greatest((abs(dn_vv) + abs(dn_vh)) / 2, 1e-12)) AS db FROM pixels"
VIEWS["mag_stats"] = "SELECT scene, count(*) AS n, quantile_cont(db, 0.02) AS p02, quantile_cont(db, 0.98) AS p98 FROM mag_db GROUP BY scene"
VIEWS["mag_clipped"] = "SELECT scene, least(greatest(db, p02), p98) AS x FROM mag_db JOIN mag_stats USING (scene) WHERE n >= 64 AND p98 - p02 >= 0.25"
fx.otsu_view("mag_otsu", "mag_clipped", "x")


@query("a10_land_water", """SELECT scene, CASE WHEN w >= 0.7 THEN 'likely_water_dominant' WHEN w <= 0.3 THEN 'likely_land_dominant' WHEN w IS NOT NULL THEN 'mixed_or_indeterminate' ELSE 'indeterminate' END AS label, round(w, 6) AS water_fraction,
    round(otsu, 6) AS threshold_db, round(CASE WHEN otsu IS NOT NULL THEN least(1, greatest(0, (p98 - p02) / 12)) END, 6) AS separability FROM mag_stats
    LEFT JOIN (SELECT scene, otsu, avg((x <= otsu)::INT) AS w FROM mag_clipped JOIN mag_otsu USING (scene) GROUP BY ALL) USING (scene)""", "mag_clipped mag_otsu mag_stats")
def a10(spark, d):
    return rounded(context.land_water(fx.pixels(spark, d), ["dn_vv", "dn_vh"]))


def _scores(spark, d) -> DataFrame:
    """Scores of windows: logistic values of embeddings; a scene is a label."""
    return fx.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("scene"), F.transform("embedding", lambda x: 1 / (1 + F.exp(-40 * x.cast("double")))).alias("scores"))


@query("a11_land_cover_scene", """SELECT scene, class, round(mean_probability, 6) AS mean_probability, round(present_share, 6) AS present_share FROM (SELECT scene, (i - 1)::INT AS class, avg(p) AS mean_probability, avg((p >= 0.95)::INT) AS present_share FROM (
    SELECT label::VARCHAR AS scene, unnest(range(1, len(embedding) + 1)) AS i, unnest(list_transform(embedding, lambda x: 1 / (1 + exp(-40 * x::DOUBLE)))) AS p FROM embeddings) GROUP BY ALL) WHERE present_share >= 0.05""")
def a11(spark, d):
    return rounded(context.scene_classes(_scores(spark, d)))


_GATE = "CASE WHEN box % 11 = 0 THEN 'unknown' WHEN west BETWEEN -31.3 AND 31.6 AND south BETWEEN 36.0 AND 70.1 THEN 'plausible' ELSE 'out_of_domain' END"


@query("f26_domain_gate", f"SELECT box, {_GATE} AS domain FROM boxes", "boxes")
def f26(spark, d):
    lon = F.when(F.col("box") % 11 != 0, F.col("west"))
    return fx.boxes(spark, d).select("box", context.domain_gate(lon, F.col("south")).alias("domain"))


@query("f27_land_cover_status", f"SELECT box, CASE WHEN box % 4 = 0 THEN 'unavailable' WHEN {_GATE} = 'out_of_domain' THEN 'out_of_domain' WHEN {_GATE} = 'unknown' THEN 'domain_unverified' ELSE 'available' END AS status FROM boxes", "boxes")
def f27(spark, d):
    lon = F.when(F.col("box") % 11 != 0, F.col("west"))
    return fx.boxes(spark, d).select("box", context.land_cover_status(context.domain_gate(lon, F.col("south")), F.col("box") % 4 != 0).alias("status"))


# -- look-up tables -----------------------------------------------------------------

VIEWS["nodes"] = """SELECT l.scene, line, pixel, 100.0 + (line * 3 + pixel * 7) % 50 AS a FROM (SELECT DISTINCT scene FROM pixels) l
    CROSS JOIN (SELECT unnest(range(0, 2001, 10)) AS line) CROSS JOIN (SELECT unnest(range(0, 101, 25)) AS pixel)"""


def _nodes(spark, d) -> DataFrame:
    scenes = fx.pixels(spark, d).select("scene").distinct()
    at = scenes.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(2000), F.lit(10)))).withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(25))))
    return at.withColumn("a", (F.lit(100.0) + (F.col("line") * 3 + F.col("pixel") * 7) % 50))


VIEWS["lut"] = """SELECT scene, r, c, top + (bottom - top) * least(greatest((r - l0) / 10.0, 0), 1) AS value FROM (
    SELECT p.scene, p.r, p.c, n00.line AS l0, n00.a + (n01.a - n00.a) * ((p.c - n00.pixel) / 25.0) AS top, n10.a + (n11.a - n10.a) * ((p.c - n00.pixel) / 25.0) AS bottom FROM pixels p
    JOIN nodes n00 ON n00.scene = p.scene AND n00.line = least(p.r // 10 * 10, 1990) AND n00.pixel = p.c // 25 * 25 JOIN nodes n01 ON n01.scene = p.scene AND n01.line = n00.line AND n01.pixel = n00.pixel + 25
    JOIN nodes n10 ON n10.scene = p.scene AND n10.line = n00.line + 10 AND n10.pixel = n00.pixel JOIN nodes n11 ON n11.scene = p.scene AND n11.line = n00.line + 10 AND n11.pixel = n00.pixel + 25)"""


@query("j08_lut_bracket", "SELECT scene, r, c, round(value, 6) AS value FROM lut", "lut")
def j08(spark, d):
    return rounded(lut.bilinear(fx.pixels(spark, d).select("scene", "r", "c"), _nodes(spark, d)))


@query("j08_lut_tiles", "SELECT scene, r, c, round(value, 6) AS value FROM lut", "lut")
def j08_tiles(spark, d):
    tiles = rasters.stored(tiling.to_tiles(fx.pixels(spark, d).select("scene", "r", "c", "dn_vv"), 32, ["dn_vv"]))
    return rounded(rasters.to_cells(rasters.bilinear(tiles, _nodes(spark, d), 32), 32, ["value"]))


@query("j10_azimuth_block_join", """SELECT scene, r, c, round(coalesce(last(f ORDER BY b), 1.0), 6)::DOUBLE AS factor FROM (SELECT p.scene, p.r, p.c, b.b, b.f FROM pixels p LEFT JOIN (VALUES (0, 0, 49, 2.0::DOUBLE), (1, 40, 69, 1.5), (2, 80, 89, 0.5)) AS b(b, lo, hi, f) ON p.c BETWEEN lo AND hi) GROUP BY scene, r, c""", "pixels")
def j10(spark, d):
    blocks = fx.pixels(spark, d).select("scene").distinct().select("scene", F.inline(F.expr("from_json('[{\"block\":0,\"first_sample\":0,\"last_sample\":49,\"factor\":2.0},{\"block\":1,\"first_sample\":40,\"last_sample\":69,\"factor\":1.5},{\"block\":2,\"first_sample\":80,\"last_sample\":89,\"factor\":0.5}]', 'array<struct<block:int,first_sample:int,last_sample:int,factor:double>>')")))
    return rounded(lut.block_factor(fx.pixels(spark, d).select("scene", "r", "c"), blocks))


@query("a21_lut_summary", "SELECT scene, count(DISTINCT line) AS lines, count(DISTINCT pixel) AS pixels, count(DISTINCT a) = 1 AS constant FROM nodes GROUP BY scene", "nodes")
def a21(spark, d):
    return lut.summary(_nodes(spark, d))


@query("f29_measure_gate", "SELECT scene, count(DISTINCT pol) AS bands, count(DISTINCT pol) = 2 AS measurable FROM (SELECT scene, 'VV' AS pol FROM pixels UNION ALL SELECT scene, 'VH' FROM pixels WHERE dn_vh > 0 AND scene <> 'flat') GROUP BY scene", "pixels")
def f29(spark, d):
    p = fx.pixels(spark, d)
    pols = p.select("scene", F.lit("VV").alias("pol")).unionAll(p.where("dn_vh > 0 and scene <> 'flat'").select("scene", F.lit("VH").alias("pol")))
    return lut.measure_gate(pols)


# -- tiles --------------------------------------------------------------------------

VIEWS["plan"] = "SELECT scene, rs::INT AS row_start, cs::INT AS col_start FROM (SELECT scene, width, unnest(range(0, height - 223, 112)) AS rs FROM scenes_sized WHERE height >= 224 AND width >= 224), LATERAL (SELECT unnest(range(0, width - 223, 112)) AS cs)"


@query("x12_patch_plan", "SELECT * FROM plan", "plan")
def x12(spark, d):
    return tiling.patch_plan(fx.scenes_sized(spark, d)).select("scene", "row_start", "col_start")


@query("m06_encode_progress", """SELECT scene, planned, done, least(100.0, round(100.0 * done / planned, 4)) AS percent FROM (SELECT scene, (((height - 224) // 112 + 1) * ((width - 224) // 112 + 1))::BIGINT AS planned, (height % 7)::BIGINT AS done FROM scenes_sized WHERE height >= 224 AND width >= 224)""", "scenes_sized")
def m06(spark, d):
    s = fx.scenes_sized(spark, d).select("scene", tiling.planned_patches(F.col("width"), F.col("height")).alias("planned"), (F.col("height") % 7).cast("long").alias("done")).where("planned > 0")
    return s.select("*", F.least(F.lit(100.0), F.round(100.0 * F.col("done") / F.col("planned"), 4)).alias("percent"))


@query("x13_grid_origins", """SELECT scene, row_off::INT AS row_off, col_off::INT AS col_off FROM (SELECT scene, w, cols, unnest(list_distinct(list_transform(range(0, rows), lambda k: floor(k * (height - 120) / greatest(rows - 1, 1))::INT))) AS row_off FROM (
    SELECT scene, width AS w, height, cols, greatest(1, round_even(20 / cols, 0)::INT) AS rows FROM (SELECT scene, width, height, greatest(1, round_even(sqrt(20 * width / height), 0)::INT) AS cols FROM scenes_sized WHERE width >= 120 AND height >= 120))),
    LATERAL (SELECT unnest(list_distinct(list_transform(range(0, cols), lambda k: floor(k * (w - 120) / greatest(cols - 1, 1))::INT))) AS col_off)""", "scenes_sized")
def x13(spark, d):
    return tiling.grid_origins(fx.scenes_sized(spark, d), 20).select("scene", "row_off", "col_off")


VIEWS["plan_digests"] = f"SELECT *, sha1(unhex('{tiling.URL_NAMESPACE}') || encode(scene || ':encoder:v1:' || row_start || ':' || col_start || ':224')) AS h FROM plan"


@query("x14_patch_identity", """SELECT scene, row_start, col_start, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][instr('0123456789abcdef', h[17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] AS patch_id
    FROM plan_digests""", "plan_digests")
def x14(spark, d):
    plan = tiling.patch_plan(fx.scenes_sized(spark, d))
    return plan.select("scene", "row_start", "col_start", tiling.patch_uuid(F.col("scene"), "encoder", "v1", F.col("row_start"), F.col("col_start")).alias("patch_id"))


@query("x18_quadrant_label", """SELECT scene, CASE WHEN width > 8192 OR height > 8192 THEN CASE WHEN height // 3 + 112 < height // 2 THEN 'north' ELSE 'south' END || CASE WHEN width // 4 + 112 < width // 2 THEN 'west' ELSE 'east' END || ' quadrant' ELSE 'full scene' END
    || ', rows ' || (height // 3) || '-' || (height // 3 + 224) || ', columns ' || (width // 4) || '-' || (width // 4 + 224) AS label FROM (SELECT scene, width * 20 AS width, height * 10 AS height FROM scenes_sized)""", "scenes_sized")
def x18(spark, d):
    s = fx.scenes_sized(spark, d).select("scene", (F.col("width") * 20).alias("width"), (F.col("height") * 10).alias("height"))
    return s.select("scene", tiling.quadrant_label(F.floor(F.col("height") / 3).cast("int"), F.floor(F.col("width") / 4).cast("int"), F.col("width"), F.col("height")).alias("label"))


@query("w13_preview_cap", "SELECT scene, rs::INT AS row_start, cs::INT AS col_start FROM (SELECT scene, rs, cs, row_number() OVER (PARTITION BY scene ORDER BY rs, cs) AS n FROM (SELECT scene, width, unnest(range(0, height - 223, 112)) AS rs FROM scenes_sized WHERE height >= 224 AND width >= 224), LATERAL (SELECT unnest(range(0, width - 223, 112)) AS cs)) WHERE n <= 6", "scenes_sized")
def w13(spark, d):
    return tiling.preview_cap(tiling.patch_plan(fx.spread(fx.scenes_sized(spark, d))), most=6).select("scene", "row_start", "col_start")


@query("a20_overview_downsample", "SELECT scene, r * h // n AS out_row, c * 32 // 100 AS out_col, round(avg(dn_vv), 6) AS mean FROM pixels, (SELECT n, greatest(1, round_even(n * 0.32, 0))::INT AS h FROM (SELECT max(r) + 1 AS n FROM pixels)) GROUP BY ALL", "pixels")
def a20(spark, d):
    p = fx.pixels(spark, d)
    rows = (p.agg(F.max("r")).first()[0] or 0) + 1
    return rounded(tiling.overview(p, rows, 100, "dn_vv", longest=max(rows, 100) * 0.32))


@query("j13_crop_window", """SELECT scene, least(greatest(y - 112, 0), height - 224)::INT AS row_off, least(greatest(x - 112, 0), width - 224)::INT AS col_off FROM (SELECT scene, width, height, (width // 3 + 20) AS x, (height // 2 + 20) AS y FROM scenes_sized) WHERE width >= 224 AND height >= 224""", "scenes_sized")
def j13(spark, d):
    x, y = F.floor(F.col("width") / 3), F.floor(F.col("height") / 2)
    crop = tiling.crop_window(x, y, x + 40, y + 40, F.col("width"), F.col("height"))
    return fx.scenes_sized(spark, d).select("scene", crop.alias("w")).where("w is not null").select("scene", "w.row_off", "w.col_off")


@query("m05_extract_patches", """SELECT p.scene, rs::INT AS row_start, cs::INT AS col_start, round(sum(dn_vv), 0) AS total FROM (SELECT scene, rs, unnest(range(0, 81, 20)) AS cs FROM (SELECT scene, m, unnest(range(0, m - 19, 20)) AS rs FROM (SELECT scene, max(r) + 1 AS m FROM pixels GROUP BY scene))) w
    JOIN pixels p ON p.scene = w.scene AND p.r >= rs AND p.r < rs + 20 AND p.c >= cs AND p.c < cs + 20 GROUP BY p.scene, rs, cs HAVING avg((dn_vv = 0)::INT) <= 0.4""", "pixels")
def m05(spark, d):
    p = fx.pixels(spark, d)
    plan = tiling.patch_plan(p.groupBy("scene").agg((F.max("r") + 1).alias("height"), F.lit(100).alias("width")), patch=20, stride=20)
    patches = tiling.extract_patches(tiling.to_tiles(p.withColumn("vv", F.col("dn_vv").cast("float")), 16, ["vv"]), plan, 16, 20, ["vv"])
    return patches.select("scene", "row_start", "col_start", F.round(F.aggregate("patch", F.lit(0.0), lambda a, x: a + x.cast("double")), 0).alias("total"))
