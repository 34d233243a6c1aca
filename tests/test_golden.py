"""Golden numbers on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from sigmaspark.functions import radiometry
from sigmaspark.operators import answers, catalog, context, detections, evidence, geo, lifecycle, lut, mechmap, routing, scattering, tiling, vectors
from sigmaspark.sources import archives


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_calibration(spark):
    r = one(spark, *[radiometry.dn_to_sigma0_db(F.lit(float(dn)), F.lit(float(a)), F.lit(float(n))) for dn, a, n in ((500, 500, 0), (50, 500, 0), (0, 500, 0), (500, 500, 90000), (300, 500, 200000))])
    assert [round(x, 6) for x in r] == [0.0, -20.0, -50.0, round(10 * math.log10(0.64), 6), -50.0]


def test_lut_bilinear_and_clamping(spark):
    nodes = spark.createDataFrame([("s", 0, 0, 100.0), ("s", 0, 100, 200.0), ("s", 100, 0, 300.0), ("s", 100, 100, 400.0)], "scene string, line long, pixel long, a double")
    at = spark.createDataFrame([("s", r, c) for r, c in ((0, 0), (0, 100), (100, 0), (100, 100), (50, 50), (500, 500), (-5, 50))], "scene string, r long, c long")
    got = {(x.r, x.c): x.value for x in lut.bilinear(at, nodes).collect()}
    assert got == {(0, 0): 100, (0, 100): 200, (100, 0): 300, (100, 100): 400, (50, 50): 250, (500, 500): 400, (-5, 50): 150}


def test_azimuth_blocks(spark):
    blocks = spark.createDataFrame([("s", 0, 0, 49, 2.0), ("s", 1, 50, 100, 1.0), ("s", 2, 40, 60, 3.0)], "scene string, block int, first_sample int, last_sample int, factor double")
    at = spark.createDataFrame([("s", 0, c) for c in (0, 45, 70, 200)], "scene string, r int, c int")
    assert {x.c: x.factor for x in lut.block_factor(at, blocks).collect()} == {0: 2.0, 45: 3.0, 70: 1.0, 200: 1.0}


def test_window_means_are_linear(spark):
    p = spark.createDataFrame([("s", 1, 0.0, -50.0), ("s", 1, -20.0, -16.0)], "scene string, w int, vv_db double, vh_db double")
    r = scattering.window_summary(p, ["scene", "w"]).first()
    assert round(r.vv_db, 1) == -3.0 and r.noise_limited_fraction == 0.5


@pytest.mark.parametrize(("vv", "vh", "name"), [(-20, -32, "smooth_surface"), (-3, -14, "double_bounce"), (-10, -11, "volume"), (-13, -25, "rough_surface"), (-22, -34, "smooth_surface")])
def test_mechanisms(spark, vv, vh, name):
    power = spark.createDataFrame([("s", 10 ** (vv / 10), 10 ** (vh / 10), 0.0)], "scene string, vv double, vh double, noise_limited_fraction double")
    t = spark.createDataFrame([("s", -15.0, -9.0, -7.0, -8.0, 0.55)], "scene string, water_max_vv_db double, water_max_ratio_db double, urban_min_vv_db double, urban_max_ratio_db double, volume_min_rvi double")
    assert scattering.classify(scattering.summarise_power(power, ["scene"]), t).first().mechanism == name


def test_majority_filter(spark):
    def filtered(cells):
        df = spark.createDataFrame([("s", r, c, v) for (r, c), v in cells.items()], "scene string, cell_row int, cell_col int, label int")
        return {(x.cell_row, x.cell_col): x.label for x in mechmap.majority_filter(df).collect()}

    stray = {(r, c): 0 for r in range(7) for c in range(7)} | {(3, 3): 2}
    assert set(filtered(stray).values()) == {0}
    block = {(r, c): 2 if 1 <= r <= 5 and 1 <= c <= 5 else 0 for r in range(7) for c in range(7)}
    assert filtered(block)[3, 3] == 2
    holes = {(r, c): None for r in range(5) for c in range(5)} | {(2, 2): 1}
    assert sum(v is None for v in filtered(holes).values()) == 24


def test_majority_repeats_the_edges(spark):
    import random

    r = random.Random(8)
    for height, width in ((1, 1), (1, 5), (4, 6)):
        grid = {(y, x): r.choice([0, 1, 2, 3, None]) for y in range(height) for x in range(width)}
        want = {}
        for (y, x), own in grid.items():
            near = [grid[min(max(y + a, 0), height - 1), min(max(x + b, 0), width - 1)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
            votes = [v for v in near if v is not None]
            want[y, x] = None if own is None else max(set(votes), key=lambda v: (votes.count(v), -v))
        df = spark.createDataFrame([("s", y, x, v) for (y, x), v in grid.items()], "scene string, cell_row int, cell_col int, label int")
        assert {(c.cell_row, c.cell_col): c.label for c in mechmap.majority_filter(df).collect()} == want


def test_quantiles_are_exact(spark):
    import numpy as np

    from sigmaspark.operators.quantiles import quantiles

    g = np.random.default_rng(3)
    own = {"a": g.normal(size=700).tolist(), "b": [1.0] * 50, "c": [0.0] * 300 + g.exponential(size=40).tolist(), "d": [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in own.items() for v in vs] + [("e", None)], "scene string, x double")
    got = {r.scene: r for r in quantiles(df, "scene", "x", [0.02, 0.5, 0.98], bins=16).collect()}
    assert set(got) == set(own)
    for k, vs in own.items():
        assert got[k].n == len(vs) and np.allclose(got[k].p, np.quantile(vs, [0.02, 0.5, 0.98]), atol=1e-12)


def test_map_fractions(spark):
    cells = spark.createDataFrame([("s", 0, 0, 0), ("s", 0, 1, 0), ("s", 1, 0, 2), ("s", 1, 1, None)], "scene string, cell_row int, cell_col int, label int")
    r = mechmap.map_fractions(cells).first()
    assert (round(r.smooth_surface, 4), round(r.volume, 4), r.double_bounce, r.valid_fraction) == (0.6667, 0.3333, 0.0, 0.75)


def test_footprint(spark):
    text = "12.809979,80.688751 13.256035,78.380257 14.763914,78.676155 14.321618,81.000298"
    df = spark.createDataFrame([(1, text)], "k int, text string").withColumn("corners", geo.parse_footprint(F.col("text")))
    r = geo.footprint_stats(df, "k").first()
    assert (round(r.lat, 4), round(r.lon, 4), round(r.width_km), round(r.height_km)) == (13.7879, 79.6864, 255, 171)
    assert one(spark, geo.format_coordinate(F.lit(13.7879), F.lit(79.6864)))[0] == "13.79°N, 79.69°E"
    for bad in ("", "1,2 3", "1,2 3,4", "a,b 1,2 3,4", "1,2,3 4,5 6,7"):
        assert one(spark, geo.parse_footprint(F.lit(bad)))[0] is None


def test_domain_and_status(spark):
    r = one(spark, *[context.domain_gate(F.lit(x), F.lit(y)) for x, y in ((14.4, 46.1), (79.7, 13.8), (-73.9, 40.7))], context.domain_gate(F.lit(None).cast("double"), F.lit(1.0)))
    assert list(r) == ["plausible", "out_of_domain", "out_of_domain", "unknown"]
    assert one(spark, context.land_cover_status(F.lit("unknown"), F.lit(True)))[0] == "domain_unverified"


@pytest.mark.parametrize(("q", "intent"), [("Is there vegetation?", "environment"), ("How many bridges", "detector_count"), ("Where is the bridge", "detector_location"), ("any tanks", "detector_presence"), ("", "scene_description"), ("show me a patch", "visual_evidence"), ("how many gas holder sites", "detector_count")])
def test_intents(spark, q, intent):
    assert one(spark, routing.query_intent(F.lit(q), F.array(F.lit("Gas Holders"))))[0] == intent


def test_labels_and_routes(spark):
    assert list(one(spark, *[routing.normalize_label(F.lit(x)) for x in ("Ferries", "glass", "bus", "Ships ")])) == ["ferry", "glass", "bus", "ship"]
    assert [one(spark, routing.keyword_route(F.lit(x)))[0] for x in ("describe where", "overview", "find", "hi")] == ["hybrid", "macro", "micro", "none"]
    rows = spark.createDataFrame([("hybrid", "steep"), ("macro", "steep"), ("micro", "flat"), ("none", "fail_floor"), (None, None)], "keyword string, spread string")
    assert [r.route for r in routing.resolve_routes(rows).collect()] == ["hybrid", "micro", "hybrid", "macro", "micro"]


def test_patch_plan_and_uuid(spark):
    import uuid

    plan = tiling.patch_plan(spark.createDataFrame([("s", 448, 336), ("t", 200, 900)], "scene string, width int, height int"))
    assert sorted((r.row_start, r.col_start) for r in plan.collect()) == [(0, 0), (0, 112), (0, 224), (112, 0), (112, 112), (112, 224)]
    assert one(spark, tiling.patch_uuid(F.lit("s"), "m", "v", F.lit(112), F.lit(0)))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "s:m:v:112:0:224"))


def test_patches_from_tiles_are_slices(spark):
    import numpy as np

    image = np.arange(40 * 50, dtype=np.float32).reshape(40, 50) + 1
    p = spark.createDataFrame([("s", r, c, float(image[r, c])) for r in range(40) for c in range(50)], "scene string, r int, c int, vv double")
    plan = tiling.patch_plan(spark.createDataFrame([("s", 50, 40)], "scene string, width int, height int"), patch=20, stride=10)
    for r in tiling.extract_patches(tiling.to_tiles(p, 16, ["vv"]), plan, 16, 20, ["vv"]).collect():
        assert np.array_equal(np.array(r.patch, np.float32).reshape(20, 20), image[r.row_start : r.row_start + 20, r.col_start : r.col_start + 20])


def greedy(boxes):
    def iou(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    kept, won = [], {}
    for b in sorted(boxes, key=lambda b: (-b[2], b[0])):
        better = [k for k in kept if k[1] == b[1] and iou(k, b) > 0.5]
        won[b[0]] = better[0][0] if better else None
        if not better:
            kept.append(b)
    return won


def test_suppression_is_greedy(spark):
    import random

    r = random.Random(5)
    boxes = []
    for k in range(120):
        x, y, s = r.randint(0, 80), r.randint(0, 80), r.randint(10, 60)
        boxes.append((k, r.choice("ab"), r.randint(0, 9) / 10, float(x), float(y), float(x + s), float(y + s)))
    df = spark.createDataFrame(boxes, "id long, label string, confidence double, x_min double, y_min double, x_max double, y_max double").withColumn("scene", F.lit("s"))
    assert {x.id: x.winner for x in detections.suppress(df).collect()} == greedy(boxes)


def test_detections_are_validated(spark):
    rows = [(1, " Ship ", "0.5", "1", "1", "5", "5"), (2, None, "2", "1", "1", "5", "5"), (3, "x", "0.1", "5", "1", "5", "5"), (4, "x", "0.1", "200", "1", "300", "5"), (5, "x", "0.1", "NaN", "1", "3", "5"), (6, "x", None, "1", "1", "3", "5"), (7, "", "1", "-3", "1", "3", "5")]
    df = spark.createDataFrame(rows, "id int, label string, confidence string, x_min string, y_min string, x_max string, y_max string").withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    got = {r.id: (r.label, r.reason, r.was_clipped) for r in detections.validate(df).collect()}
    assert got[1] == ("ship", None, False) and got[7] == ("unknown", None, True)
    assert [got[k][1] for k in (2, 3, 4, 5, 6)] == ["confidence", "area", "outside", "coordinates", "confidence"]


def test_absence_is_not_proof(spark):
    say = lambda n, status: one(spark, answers.detector_answer(F.lit("ship"), F.lit(status), F.lit(n), F.lit(0.76), F.lit(0.91), F.lit(""), F.lit(True), F.lit(False)))[0]
    assert "76% to 91%" in say(2, "completed") and "doesn't prove" in say(0, "completed") and "Undecided" in say(0, "unknown")


def test_catalogue_and_boxes(spark):
    assert one(spark, catalog.box_reason(*map(F.lit, (10.0, 0.0, 9.0, 1.0))))[0] == "east_not_east_of_west"
    assert one(spark, catalog.odata_timestamp(F.lit("not a time")))[0] is None
    b = spark.createDataFrame([(1, 0.0, 0.0, 25.0, 25.0), (2, 20.0, 20.0, 30.0, 30.0), (3, 26.0, 0.0, 27.0, 1.0)], "box int, west double, south double, east double, north double")
    assert sorted((r.l_box, r.r_box) for r in catalog.boxes_meet(b, b).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_scope_is_whole(spark):
    v = spark.createDataFrame([(1, 1, 1, 1)], "owner int, project int, scene int, point_id int")
    with pytest.raises(ValueError):
        vectors.scoped(v, F.lit(1), None)
    assert vectors.scoped(v, F.lit(1), F.lit(1), scenes=[]).count() == 0


def test_history_budget(spark):
    m = spark.createDataFrame([(1, t, "user", "x" * 40, "complete") for t in range(20)], "conversation int, turn int, role string, content string, status string")
    got = evidence.history(m, each=30, total=100).orderBy("turn").collect()
    assert [(r.turn, len(r.content)) for r in got] == [(8, 30), (9, 30), (10, 30), (11, 10)]


def test_rules_and_transitions(spark):
    ok = lambda a, b, k="process_scene": one(spark, lifecycle.transition_allowed(F.lit(a), F.lit(b), F.lit(k)))[0]
    assert ok("queued", "validating") and not ok("queued", "processing") and ok("queued", "processing", "cleanup_scene") and not ok("ready", "queued") and ok("failed", "failed")
    assert one(spark, *[lifecycle.safe_name(F.lit(x)) for x in ("a.tif", ".a", "a/b", "ü")]) == (True, False, False, False)


def test_archive_rules(spark):
    good = [("p/manifest.safe", 1), ("p/measurement/s-vv-1.tiff", 1), ("p/measurement/s-vh-2.tiff", 1), *[(f"p/annotation/calibration/{k}-s-{b}-1.xml", 1) for k in ("calibration", "noise") for b in ("vv", "vh")]]
    m = spark.createDataFrame([("a", n) for n, _ in good] + [("b", n) for n, _ in good[1:]] + [("c", n) for n, _ in good[:-1]], "archive string, name string")
    assert {r.archive: r.reason for r in archives.layout_reason(m).collect()} == {"a": None, "b": "manifest", "c": "noise"}
    m = m.where("archive = 'a'").unionAll(spark.createDataFrame([("d", "../x"), ("d", "p/manifest.safe")], "archive string, name string")).withColumn("size", F.lit(1)).withColumn("compressed", F.lit(1)).withColumn("flags", F.lit(0)).withColumn("mode", F.lit(0))
    assert {r.archive: r.reason for r in archives.safety_reason(m).collect()} == {"a": None, "d": "path"}
