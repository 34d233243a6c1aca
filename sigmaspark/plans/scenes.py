"""Queries over catalogue, geometry and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, detections, geo, tiling
from . import fixtures as fx
from .fixtures import rounded
from .registry import VIEWS, query

_BOX = ("west", "south", "east", "north")


def _b() -> tuple:
    return tuple(F.col(c) for c in _BOX)


_HAV = lambda a, b, c, d: f"(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1))))"
VIEWS["extents"] = f"SELECT *, {_HAV('(south + north) / 2', 'west', '(south + north) / 2', 'east')} AS w, {_HAV('south', 'west', 'north', 'west')} AS h FROM boxes"
VIEWS["spans"] = "SELECT *, radians(east - west) * cos(radians((south + north) / 2)) * 6371.0 AS w, radians(north - south) * 6371.0 AS h FROM boxes"


@query("x06_bbox_extent_km", "SELECT box, round(w, 6) AS width_km, round(h, 6) AS height_km FROM extents", "extents")
def x06(spark, d):
    w, h = catalog.extent_km(*_b())
    return rounded(fx.boxes(spark, d).select("box", w.alias("width_km"), h.alias("height_km")))


@query("x07_span_km_equirect", "SELECT box, round(w, 6) AS width_km, round(h, 6) AS height_km FROM spans", "spans")
def x07(spark, d):
    w, h = catalog.span_equirect_km(*_b())
    return rounded(fx.boxes(spark, d).select("box", w.alias("width_km"), h.alias("height_km")))


@query("f03_aoi_validate", "SELECT box, CASE WHEN east <= west THEN 'east_not_east_of_west' WHEN north <= south THEN 'north_not_north_of_south' WHEN w * h > 250000 THEN 'area_too_large' END AS reason FROM extents", "extents")
def f03(spark, d):
    return fx.boxes(spark, d).select("box", catalog.box_reason(*_b()).alias("reason"))


@query("f05_subset_plan", "SELECT box, ceil(w * 100)::INT AS width_px, ceil(h * 100)::INT AS height_px, CASE WHEN ceil(w * 100) > 2500 OR ceil(h * 100) > 2500 THEN 'too_large' END AS reason FROM spans", "spans")
def f05(spark, d):
    w, h = catalog.subset_pixels(*_b())
    return fx.boxes(spark, d).select("box", w.alias("width_px"), h.alias("height_px")).withColumn("reason", catalog.subset_reason(F.col("width_px"), F.col("height_px")))


@query("a23_transfer_totals", "SELECT box % 10 AS acquisition, sum(w * h)::BIGINT AS pixels, round(sum(w * h) / 1e6, 6) AS megapixels FROM (SELECT box, greatest(ceil(w * 100), 0)::BIGINT AS w, greatest(ceil(h * 100), 0)::BIGINT AS h FROM spans) GROUP BY ALL", "spans")
def a23(spark, d):
    w, h = catalog.subset_pixels(*_b())
    px = fx.boxes(spark, d).select((F.col("box") % 10).alias("acquisition"), (F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0)).cast("long")).alias("px"))
    return rounded(px.groupBy("acquisition").agg(F.sum("px").alias("pixels"), (F.sum("px") / 1e6).alias("megapixels")))


@query("f04_date_window_validate", """SELECT o_orderkey, CASE WHEN e < s THEN 'end_before_start' WHEN date_diff('day', s, e) > 90 THEN 'window_too_long' END AS reason, strftime(s, '%Y-%m-%d') AS first_day FROM (
    SELECT o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + ((o_orderkey % 130) - 15)::INT AS e FROM orders)""")
def f04(spark, d):
    o = fx.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    o = o.withColumn("e", F.date_add("s", (F.col("o_orderkey") % 130 - 15).cast("int")))
    return o.select("o_orderkey", catalog.window_reason(F.col("s"), F.col("e")).alias("reason"), F.date_format("s", "yyyy-MM-dd").alias("first_day"))


@query("f06_acquisition_time_pin", """SELECT a.event_id AS wanted, b.event_id AS found FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 30000000""")
def f06(spark, d):
    e = fx.read(spark, d, "events")
    wanted = e.where("event_type = 'purchase'").select(F.col("event_id").alias("wanted"), "user_id", F.col("ts").cast("timestamp").alias("start"))
    return catalog.pin_acquisition(wanted, e.select(F.col("event_id").alias("found"), "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id").select("wanted", "found")


def _product_json(spark, d) -> DataFrame:
    """Catalogue lines, one per order: names, types, channels and sizes of several kinds."""
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", "o_totalprice")
    name = F.concat(F.when(F.col("k") % 7 == 0, "S1A_IW_GRDM_1SDV_").when(F.col("k") % 5 == 0, "S1A_IW_GRDH_1SSV_").otherwise("S1A_IW_GRDH_1SDV_"), F.col("k"), F.lit(".SAFE"))
    attrs = F.array(*[F.struct(F.lit(n).alias("Name"), v.cast("string").alias("Value")) for n, v in (
        ("productType", F.when(F.col("k") % 7 == 0, "IW_GRDM_1S").otherwise("IW_GRDH_1S")), ("polarisationChannels", F.when(F.col("k") % 5 == 0, "VV").otherwise("VV&VH")), ("platformSerialIdentifier", F.lit("A")), ("orbitDirection", F.when(F.col("k") % 2 == 0, "ASCENDING").otherwise("DESCENDING")))])
    body = F.struct(F.concat(F.lit("p-"), F.col("k")).alias("Id"), name.alias("Name"), F.when(F.col("k") % 11 != 0, F.floor(F.col("o_totalprice") * 10000).cast("string")).alias("ContentLength"), F.when(F.col("k") % 3 == 0, F.lit(False)).alias("Online"),
                    F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.123456789Z'").alias("Start")).alias("ContentDate"), attrs.alias("Attributes"))
    return o.select(F.to_json(body).alias("value"))


VIEWS["products"] = """SELECT 'p-' || k AS id, name, CASE WHEN k % 11 <> 0 THEN floor(o_totalprice * 10000)::BIGINT END AS size_bytes, k % 3 <> 0 AS online, o_orderdate::TIMESTAMP + INTERVAL 123456 MICROSECOND AS start, 'S1A' AS platform,
    CASE WHEN k % 7 = 0 THEN 'IW_GRDM_1S' ELSE 'IW_GRDH_1S' END AS product_type, CASE WHEN k % 5 = 0 THEN 'VV' ELSE 'VV&VH' END AS channels, CASE WHEN k % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit FROM (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'S1A_IW_GRDM_1SDV_' WHEN o_orderkey % 5 = 0 THEN 'S1A_IW_GRDH_1SSV_' ELSE 'S1A_IW_GRDH_1SDV_' END || o_orderkey AS name, * FROM orders)"""


@query("s06_catalogue_scan", "SELECT id, name, size_bytes, online, epoch_us(start) AS start_us, platform, product_type, channels, orbit FROM products", "products")
def s06(spark, d):
    return catalog.products(_product_json(spark, d)).select("id", "name", "size_bytes", "online", F.unix_micros("start").alias("start_us"), "platform", "product_type", "channels", "orbit")


_CONTRACT = "product_type = 'IW_GRDH_1S' AND channels = 'VV&VH' AND start BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-01-01' AND regexp_matches(name, '^S1[A-D]_IW_GRDH_1SDV_')"


def _range():
    return F.lit("1994-01-01T00:00:00Z").cast("timestamp"), F.lit("1997-01-01T00:00:00Z").cast("timestamp")


@query("f01_catalogue_contract", f"SELECT id, online FROM products WHERE {_CONTRACT}", "products")
def f01(spark, d):
    return catalog.contract(catalog.products(_product_json(spark, d)), *_range()).select("id", "online")


@query("t04_catalogue_top", f"SELECT id, online FROM products WHERE {_CONTRACT} ORDER BY start DESC, id LIMIT 50", "products")
def t04(spark, d):
    return catalog.contract(catalog.products(_product_json(spark, d)), *_range(), most=50).select("id", "online")


@query("f02_product_usability", """SELECT id, CASE WHEN NOT regexp_matches(name, '^S1[A-D]_IW_GRDH_1SDV_') THEN 'name' WHEN product_type <> 'IW_GRDH_1S' THEN 'type' WHEN channels <> 'VV&VH' THEN 'polarisation' WHEN NOT online THEN 'offline'
    WHEN size_bytes IS NULL OR size_bytes <= 0 THEN 'size_missing' WHEN size_bytes > 2000000000 THEN 'too_large' WHEN id LIKE '%8' THEN 'name_changed' END AS reason FROM products""", "products")
def f02(spark, d):
    asked = F.when(F.col("id").endswith("8"), "another").otherwise(F.col("name"))
    return catalog.products(_product_json(spark, d)).select("id", catalog.usability(asked).alias("reason"))


@query("f23_product_metadata", "SELECT id, len(list_filter([name, size_bytes::VARCHAR, platform, orbit], lambda x: x IS NOT NULL))::INT AS fields, name AS stated_name FROM products", "products")
def f23(spark, d):
    m = catalog.product_metadata(catalog.products(_product_json(spark, d)), ["name", "size_bytes", "platform", "orbit"])
    return m.select("id", F.size("metadata").alias("fields"), F.col("metadata")["name"].alias("stated_name"))


@query("f25_product_contract_rules", "SELECT id, product_type = 'IW_GRDH_1S' AS type_ok, channels = 'VV&VH' AS channels_ok, regexp_matches(name, '^S1[A-D]_IW_GRDH_1SDV_') AS name_ok, coalesce(size_bytes > 0, false) AS size_ok FROM products", "products")
def f25(spark, d):
    p = catalog.products(_product_json(spark, d))
    return p.select("id", (F.col("product_type") == catalog.PRODUCT_TYPE).alias("type_ok"), (F.col("channels") == catalog.CHANNELS).alias("channels_ok"), F.col("name").rlike(catalog.NAME_PATTERN).alias("name_ok"), F.coalesce(F.col("size_bytes") > 0, F.lit(False)).alias("size_ok"))


@query("x21_odata_timestamp", "SELECT event_id, epoch_us(date_trunc('second', ts)) + 250000 AS us FROM events")
def x21(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ".250000999Z").otherwise(".25"))
    return fx.read(spark, d, "events").select("event_id", F.unix_micros(catalog.odata_timestamp(text)).alias("us"))


@query("x22_polarisations", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'VV,VH' WHEN p_partkey % 3 = 1 THEN 'HH' ELSE 'Unknown' END AS pols FROM part")
def x22(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, "vh&vv dual").when(F.col("p_partkey") % 3 == 1, "HH only").otherwise("none")
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(catalog.polarisations(text), ",").alias("pols"))


@query("j09_bbox_intersects", "SELECT a.box AS left_box, b.box AS right_box FROM boxes a JOIN boxes b ON a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north WHERE a.east > a.west AND a.north > a.south AND b.east > b.west AND b.north > b.south", "boxes")
def j09(spark, d):
    b = fx.boxes(spark, d)
    return catalog.boxes_meet(b, b).select(F.col("l_box").alias("left_box"), F.col("r_box").alias("right_box"))


# -- geometry -----------------------------------------------------------------------

def _footprints(spark, d) -> DataFrame:
    """Footprint texts of suppliers' boxes; every seventh is malformed."""
    b = fx.boxes(spark, d).select("box", *[F.round(c, 4).alias(c) for c in _BOX])
    point = lambda a, o: F.concat(F.col(a).cast("string"), F.lit(","), F.col(o).cast("string"))
    good = F.concat_ws(" ", point("south", "west"), point("south", "east"), point("north", "east"), point("north", "west"))
    return b.select("box", *_BOX, F.when(F.col("box") % 7 == 0, F.concat_ws(" ", F.lit("x,1"), good)).otherwise(good).alias("text"))


VIEWS["rb"] = "SELECT box, round(west, 4) AS west, round(south, 4) AS south, round(east, 4) AS east, round(north, 4) AS north FROM boxes"


@query("x15_footprint_parse", "SELECT box, CASE WHEN box % 7 <> 0 THEN 4 END AS strict_corners, 4 AS lenient_corners, round(west, 4) AS first_lon FROM rb", "rb")
def x15(spark, d):
    f = _footprints(spark, d)
    lenient = geo.parse_footprint(F.col("text"), strict=False)
    corners = geo.parse_footprint(F.col("text"))
    return f.select("box", F.when(corners.isNotNull(), F.size(corners)).alias("strict_corners"), F.size(lenient).alias("lenient_corners"), lenient[0]["lon"].alias("first_lon"))


_SIDES = f"{_HAV('south', 'west', 'south', 'east')} AS s0, {_HAV('south', 'east', 'north', 'east')} AS s1, {_HAV('north', 'east', 'north', 'west')} AS s2, {_HAV('north', 'west', 'south', 'west')} AS s3"


@query("a19_footprint_stats", f"SELECT box, round((south + south + north + north) / 4, 6) AS lat, round((west + east + east + west) / 4, 6) AS lon, round(greatest((s0 + s2) / 2, (s1 + s3) / 2), 6) AS width_km, round(least((s0 + s2) / 2, (s1 + s3) / 2), 6) AS height_km FROM (SELECT *, {_SIDES} FROM rb WHERE box % 7 <> 0)", "rb")
def a19(spark, d):
    return rounded(geo.footprint_stats(_footprints(spark, d).withColumn("corners", geo.parse_footprint(F.col("text"))), "box"))


@query("x16_format_coordinate", "SELECT box, printf('%.2f°%s, %.2f°%s', abs(south), CASE WHEN south >= 0 THEN 'N' ELSE 'S' END, abs(west), CASE WHEN west >= 0 THEN 'E' ELSE 'W' END) AS place FROM rb", "rb")
def x16(spark, d):
    return _footprints(spark, d).select("box", geo.format_coordinate(F.col("south"), F.col("west")).alias("place"))


@query("x19_georeference", "SELECT box, CASE WHEN box % 4 <> 0 THEN round(0.0001 * 50 + west, 8) END AS lon, CASE WHEN box % 4 <> 0 THEN round(-0.0001 * 70 + north, 8) END AS lat FROM rb", "rb")
def x19(spark, d):
    affine = F.array(F.lit(0.0001), F.lit(0.0), F.col("west"), F.lit(0.0), F.lit(-0.0001), F.col("north"))
    return _footprints(spark, d).select("box", geo.georeference(F.lit(50.0), F.lit(70.0), affine, F.col("box") % 4 != 0).alias("p")).select("box", "p.lon", "p.lat")


@query("x40_scene_centroid", "SELECT box, round(CASE WHEN box % 3 = 0 THEN west ELSE (west + east + east + west) / 4 END, 6) AS lon, round(CASE WHEN box % 3 = 0 THEN south ELSE (south + south + north + north) / 4 END, 6) AS lat FROM rb", "rb")
def x40(spark, d):
    own = F.when(F.col("box") % 3 == 0, F.col("west")), F.when(F.col("box") % 3 == 0, F.col("south"))
    f = _footprints(spark, d).withColumn("corners", geo.parse_footprint(F.col("text"), strict=False))
    return rounded(f.select("box", geo.scene_centroid(*own, F.col("corners")).alias("p")).select("box", "p.lon", "p.lat"))


@query("x38_geography_struct", "SELECT box, CASE WHEN box % 2 = 0 THEN 38.5 WHEN box % 3 = 0 THEN 30.0 END::DOUBLE AS incidence, CASE WHEN box % 5 = 0 THEN 'ascending' END AS orbit, box % 2 = 0 OR box % 3 = 0 OR box % 5 = 0 AS known FROM rb", "rb")
def x38(spark, d):
    n = F.lit(None).cast("int")
    g = geo.geography(F.lit(None).cast("string"), F.when(F.col("box") % 2 == 0, 38.5), F.when(F.col("box") % 3 == 0, 30.0), F.when(F.col("box") % 5 == 0, "ASCENDING"), n, n)
    return _footprints(spark, d).select("box", g.alias("g")).select("box", F.col("g.incidence_angle_deg").alias("incidence"), F.col("g.orbit_direction").alias("orbit"), F.col("g").isNotNull().alias("known"))


# -- detections ---------------------------------------------------------------------

def _detections(spark, d) -> DataFrame:
    """Boxes of parts in one scene of 1000 x 1000; scenes hold 4000 parts each."""
    k = F.col("p_partkey")
    x, y, side = k * 37 % 1000, k * 91 % 1000, F.col("p_size") * 4
    return fx.read(spark, d, "part").select(k.alias("id"), F.concat(F.lit("scene-"), F.floor(k / 4000)).alias("scene"), F.col("p_brand").alias("label"), (k * 17 % 101 / 100.0).alias("confidence"),
        x.cast("double").alias("x_min"), y.cast("double").alias("y_min"), (x + side).cast("double").alias("x_max"), (y + side).cast("double").alias("y_max"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))


VIEWS["dets"] = """SELECT p_partkey AS id, 'scene-' || (p_partkey // 4000) AS scene, p_brand AS label, p_partkey * 17 % 101 / 100.0::DOUBLE AS confidence, (p_partkey * 37 % 1000)::DOUBLE AS x_min, (p_partkey * 91 % 1000)::DOUBLE AS y_min,
    (p_partkey * 37 % 1000 + p_size * 4)::DOUBLE AS x_max, (p_partkey * 91 % 1000 + p_size * 4)::DOUBLE AS y_max FROM part"""
VIEWS["valid_dets"] = "SELECT id, scene, lower(trim(label)) AS label, confidence, least(x_min, 1000) AS x_min, least(y_min, 1000) AS y_min, least(x_max, 1000) AS x_max, least(y_max, 1000) AS y_max, x_max > 1000 OR y_max > 1000 AS was_clipped FROM dets"


def _valid(spark, d) -> DataFrame:
    return detections.validate(_detections(spark, d)).where("reason is null")


@query("f19_detection_validate", """SELECT id, lower(trim(label)) AS label, CASE WHEN confidence > 1 THEN 'confidence' WHEN x_max <= x_min OR y_max <= y_min THEN 'area' WHEN least(x_max, 900) <= least(x_min, 900) OR least(y_max, 900) <= least(y_min, 900) THEN 'outside' END AS reason,
    x_min > 900 OR y_min > 900 OR x_max > 900 OR y_max > 900 AS was_clipped FROM (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN confidence + 1.5 ELSE confidence END AS confidence, CASE WHEN id % 10 = 0 THEN x_min ELSE x_max END AS x_max) FROM dets)""", "dets")
def f19(spark, d):
    raw = _detections(spark, d).withColumn("confidence", F.when(F.col("id") % 9 == 0, F.col("confidence") + 1.5).otherwise(F.col("confidence"))).withColumn("x_max", F.when(F.col("id") % 10 == 0, F.col("x_min")).otherwise(F.col("x_max"))).withColumn("width", F.lit(900)).withColumn("height", F.lit(900))
    return detections.validate(raw).select("id", "label", "reason", "was_clipped")


_IOU = "w * h / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) - w * h)"
VIEWS["det_pairs"] = """SELECT scene, label, better, worse, i / (s - i) AS iou FROM (SELECT a.scene, a.label, a.id AS better, b.id AS worse, (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) AS s,
    greatest(least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min), 0) * greatest(least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min), 0) AS i
    FROM valid_dets a JOIN valid_dets b ON a.scene = b.scene AND a.label = b.label AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.id < b.id))) WHERE i / (s - i) > 0.5"""


@query("j12_iou_pairs", "SELECT scene, label, better, worse, round(iou, 6) AS iou FROM det_pairs", "det_pairs")
def j12(spark, d):
    return rounded(detections.iou_pairs(_valid(spark, d)).drop("confidence"))


# boxes of a scene and label in their order; the kept ones so far go along as a list
VIEWS["nms_order"] = """SELECT d.scene, d.label, d.id, row_number() OVER (PARTITION BY d.scene, d.label ORDER BY d.confidence DESC, d.id) AS n, coalesce(over, []) AS over
    FROM valid_dets d LEFT JOIN (SELECT scene, label, worse AS id, list(better) AS over FROM det_pairs GROUP BY ALL) USING (scene, label, id)"""
_NMS = """SELECT scene, id, winner FROM (
    WITH RECURSIVE run AS (
        SELECT scene, label, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS winner, []::BIGINT[] AS kept FROM nms_order WHERE n = 1
        UNION ALL
        SELECT scene, label, n, id, winner, CASE WHEN winner IS NULL THEN list_append(kept, id) ELSE kept END
        FROM (SELECT o.*, r.kept, list_filter(r.kept, lambda x: list_contains(o.over, x))[1] AS winner FROM run r JOIN nms_order o ON o.scene = r.scene AND o.label = r.label AND o.n = r.n + 1))
    SELECT * FROM run WHERE n > 0)"""


@query("w09_nms", _NMS, "nms_order")
def w09(spark, d):
    return detections.suppress(_valid(spark, d)).select("scene", "id", "winner")


@query("w09_nms_rounds", _NMS, "nms_order")
def w09_rounds(spark, d):
    return detections.suppress(_valid(spark, d), one_pass=10).select("scene", "id", "winner")


@query("w10_object_numbering", "SELECT id, printf('object-%04d', row_number() OVER (PARTITION BY scene ORDER BY confidence DESC, id)) AS object_id FROM valid_dets", "valid_dets")
def w10(spark, d):
    return detections.numbered(_valid(spark, d)).select("id", "object_id")


@query("a12_detector_summary", "SELECT scene, count(*) AS raw, count(*) FILTER (id % 9 <> 0) AS valid, count(*) FILTER (id % 9 = 0) AS errors, 'completed' AS status FROM dets GROUP BY scene", "dets")
def a12(spark, d):
    raw = _detections(spark, d).withColumn("confidence", F.when(F.col("id") % 9 == 0, F.col("confidence") + 1.5).otherwise(F.col("confidence")))
    counts = detections.validate(raw).groupBy("scene").agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("errors"))
    return counts.withColumn("files", F.lit(1)).withColumn("readable", F.lit(1)).select("scene", "raw", "valid", "errors", detections.status(counts).alias("status"))


_V = "CASE WHEN (y_min + y_max) / 2 < 1000 / 3 THEN 'upper' WHEN (y_min + y_max) / 2 < 2000 / 3 THEN 'central' ELSE 'lower' END"
_H = "CASE WHEN (x_min + x_max) / 2 < 1000 / 3 THEN 'left' WHEN (x_min + x_max) / 2 < 2000 / 3 THEN 'central' ELSE 'right' END"
VIEWS["regions"] = f"SELECT *, CASE WHEN {_V} = 'central' AND {_H} = 'central' THEN 'central' ELSE {_V} || ' ' || {_H} END AS region FROM valid_dets"


@query("x17_region_name", "SELECT id, region FROM regions", "regions")
def x17(spark, d):
    mid = lambda a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2
    return _valid(spark, d).select("id", geo.region_name(mid("x"), mid("y"), F.col("width"), F.col("height")).alias("region"))


@query("x20_box_centroid", "SELECT id, round((x_min + x_max) / 2, 3) AS x, round((y_min + y_max) / 2, 3) AS y FROM valid_dets", "valid_dets")
def x20(spark, d):
    return _valid(spark, d).select("id", geo.box_centroid(*[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]).alias("p")).select("id", "p.x", "p.y")


@query("a13_spatial_groups", "SELECT scene, label, region, count(*) AS n FROM regions GROUP BY ALL", "regions")
def a13(spark, d):
    return detections.spatial_groups(_valid(spark, d))


@query("a14_label_counts", "SELECT scene, string_agg(label || ' (' || n || ')', ', ' ORDER BY label || ' (' || n || ')') AS labels FROM (SELECT scene, label, count(*) AS n FROM valid_dets GROUP BY ALL) GROUP BY scene", "valid_dets")
def a14(spark, d):
    return detections.label_counts(_valid(spark, d))


@query("a24_answer_stats", """SELECT question, q.scene, q.label, count(confidence) AS matches, min(confidence) AS low, max(confidence) AS high, coalesce(string_agg(DISTINCT region, ', ' ORDER BY region), '') AS regions FROM (
    SELECT s_suppkey AS question, 'scene-0' AS scene, 'brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 6) AS label FROM supplier) q LEFT JOIN regions r ON r.scene = q.scene AND r.label = q.label GROUP BY ALL""", "regions")
def a24(spark, d):
    k = F.col("s_suppkey")
    asked = fx.read(spark, d, "supplier").select(k.alias("question"), F.lit("scene-0").alias("scene"), F.concat(F.lit("brand#"), 1 + k % 5, 1 + k % 6).alias("label"))
    return detections.answer_stats(asked, _valid(spark, d))


@query("f20_safe_facts", "SELECT scene, position, substr(label, 1, 160) AS label, id::VARCHAR AS id, least(confidence * 2, 1) AS confidence FROM (SELECT scene, id AS position, id, label, confidence, row_number() OVER (PARTITION BY scene ORDER BY id) AS n FROM valid_dets) WHERE n <= 50", "valid_dets")
def f20(spark, d):
    return detections.safe_facts(_valid(spark, d).withColumn("position", F.col("id")).withColumn("confidence", F.col("confidence") * 2))


@query("s08_detector_scan", "SELECT scene, CASE WHEN count(id) = 0 THEN 'invalid_detector_output' ELSE 'completed' END AS status, count(id) AS found FROM (SELECT scene, id FROM dets WHERE id % 13 <> 0 UNION ALL SELECT scene || '-bad', NULL FROM dets WHERE id % 13 = 0) GROUP BY scene", "dets")
def s08(spark, d):
    item = F.struct(F.col("id").cast("string").alias("id"), "label", F.col("confidence").cast("string").alias("confidence"))
    good = _detections(spark, d).where("id % 13 <> 0").select("scene", F.when(F.col("id") % 2 == 0, F.to_json(F.array(item))).otherwise(F.concat(F.lit('{"detections":'), F.to_json(F.array(item)), F.lit("}"))).alias("value"))
    files = good.unionAll(_detections(spark, d).where("id % 13 = 0").select(F.concat("scene", F.lit("-bad")).alias("scene"), F.lit("{broken").alias("value")))
    counts = detections.detector_scan(files).groupBy("scene").agg(F.count("*").alias("files"), F.count_if("readable").alias("readable"), F.count("d.id").alias("valid"))
    return counts.select("scene", detections.status(counts).alias("status"), F.col("valid").alias("found"))


_SUM = "sha256(c_custkey::VARCHAR)"


@query("s09_detector_contract", f"""SELECT c_custkey AS scene, CASE WHEN c_custkey % 5 = 0 THEN 'not_a_sidecar' WHEN c_custkey % 7 = 0 THEN 'name' WHEN c_custkey % 11 = 0 THEN 'version' WHEN c_custkey % 13 = 0 THEN 'checksum' WHEN c_custkey % 17 = 0 THEN 'detections' END AS reason FROM customer""")
def s09(spark, d):
    k = F.col("c_custkey")
    c = fx.read(spark, d, "customer")
    files = c.select(k.alias("scene"), F.when(k % 5 != 0, detections.CONTRACT).alias("contract"), F.when(k % 7 != 0, "detector").otherwise(" ").alias("name"), F.when(k % 11 != 0, "1").alias("version"), F.sha2(k.cast("string"), 256).alias("checksum"), F.when(k % 17 != 0, "[]").alias("detections"))
    sources = c.where("c_custkey % 13 <> 0").select(F.sha2(k.cast("string"), 256).alias("checksum"))
    return detections.sidecar_reason(files, sources).select("scene", "reason")


@query("j16_checksum_provenance", "SELECT c_custkey AS scene FROM customer WHERE c_custkey % 13 <> 0")
def j16(spark, d):
    c = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("scene"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("checksum"))
    return c.join(c.where("scene % 13 <> 0").select("checksum"), "checksum", "left_semi").select("scene")


@query("j19_quadrant_overviews", """SELECT DISTINCT scene, q AS quadrant FROM (SELECT scene, CASE WHEN (y_min + y_max) / 2 < 500 THEN 'north' ELSE 'south' END || CASE WHEN (x_min + x_max) / 2 < 500 THEN 'west' ELSE 'east' END AS q FROM valid_dets WHERE confidence > 0.5)
    UNION SELECT DISTINCT scene, 'full' FROM valid_dets""", "valid_dets")
def j19(spark, d):
    v = _valid(spark, d)
    north, west = (F.col("y_min") + F.col("y_max")) / 2 < 500, (F.col("x_min") + F.col("x_max")) / 2 < 500
    hits = v.where("confidence > 0.5").select("scene", F.concat(F.when(north, "north").otherwise("south"), F.when(west, "west").otherwise("east")).alias("quadrant"))
    kinds = v.select("scene").distinct().withColumn("quadrant", F.explode(F.array(*map(F.lit, ("northwest", "northeast", "southwest", "southeast", "full")))))
    return kinds.where("quadrant <> 'full'").join(hits, ["scene", "quadrant"], "left_semi").unionAll(kinds.where("quadrant = 'full'"))
