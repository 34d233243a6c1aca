"""The driver's tables as tables of this domain, for Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.radiometry import dn_to_sigma0_db
from .registry import VIEWS

A2 = 1e6


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(keys: DataFrame, a_core: int = 4) -> DataFrame:
    """The rows over some tasks a core: files are made from each key, and a table of keys may be one row group."""
    return keys.repartition(a_core * keys.sparkSession.sparkContext.defaultParallelism)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Three scenes of digital numbers on a grid of 100 columns, from the events' values."""
    scenes = F.explode(F.expr("array(struct('overlap' as scene, 1.0D as gain), struct('fitted' as scene, 0.5D as gain), struct('flat' as scene, 0.5D as gain))")).alias("s")
    at = read(spark, d, "events").select((F.col("event_id") / 100).cast("int").alias("r"), (F.col("event_id") % 100).cast("int").alias("c"), F.coalesce("value", F.lit(0.0)).alias("value"), scenes)
    k = F.when(F.col("s.scene") == "flat", 3).otherwise((F.floor(F.col("r") / 20) + F.floor(F.col("c") / 20)) % 4)
    p = at.select("s.scene", "r", "c", (F.col("value") * 10 * F.col("s.gain")).alias("x"), k.alias("k"))
    f = F.element_at(F.array(*map(F.lit, (0.3, 0.8, 2.5, 0.6))), F.col("k").cast("int") + 1)
    g = F.element_at(F.array(*map(F.lit, (0.12, 0.6, 0.3, 0.3))), F.col("k").cast("int") + 1)
    return p.select("scene", "r", "c", (F.col("x") * f).alias("dn_vv"), (F.col("x") * f * g).alias("dn_vh"))


VIEWS["pixels"] = """SELECT scene, r, c, x * [0.3, 0.8, 2.5, 0.6][k + 1]::DOUBLE AS dn_vv, x * [0.3, 0.8, 2.5, 0.6][k + 1]::DOUBLE * [0.12, 0.6, 0.3, 0.3][k + 1]::DOUBLE AS dn_vh FROM (
    SELECT scene, r, c, value * 10 * gain AS x, (CASE WHEN scene = 'flat' THEN 3 ELSE (r // 20 + c // 20) % 4 END)::INT AS k FROM (
        SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, coalesce(value, 0) AS value FROM events)
    CROSS JOIN (VALUES ('overlap', 1.0::DOUBLE), ('fitted', 0.5::DOUBLE), ('flat', 0.5::DOUBLE)) AS s(scene, gain))"""


def sigma(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("scene", "r", "c", *[dn_to_sigma0_db(F.col(f"dn_{b}"), F.lit(1000.0)).alias(f"{b}_db") for b in ("vv", "vh")])


VIEWS["sigma"] = f"SELECT scene, r, c, 10 * log10(greatest(dn_vv * dn_vv / {A2}, 1e-5)) AS vv_db, 10 * log10(greatest(dn_vh * dn_vh / {A2}, 1e-5)) AS vh_db FROM pixels"

KEYS = ["scene", "wr", "wc"]


def windowed(df: DataFrame) -> DataFrame:
    return df.withColumn("wr", F.floor(F.col("r") / 5).cast("int")).withColumn("wc", F.floor(F.col("c") / 5).cast("int"))


VIEWS["windows"] = """SELECT scene, wr, wc, 10 * log10(greatest(vv, 1e-5)) AS vv_db, 10 * log10(greatest(vh, 1e-5)) AS vh_db, 10 * log10(greatest(vh, 1e-5)) - 10 * log10(greatest(vv, 1e-5)) AS ratio_db,
    CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) ELSE 0 END AS rvi, noise_limited_fraction FROM (
    SELECT scene, r // 5 AS wr, c // 5 AS wc, avg(pow(10, vv_db / 10)) AS vv, avg(pow(10, vh_db / 10)) AS vh, avg(CASE WHEN pow(10, vh_db / 10) <= 1e-5 * 1.000001 THEN 1.0 ELSE 0.0 END) AS noise_limited_fraction FROM sigma GROUP BY ALL)"""


def otsu_view(name: str, source: str, value: str) -> None:
    """Views ``name``: scene, otsu over ``value`` of ``source``."""
    VIEWS[f"{name}_spread"] = f"SELECT scene, min({value}) AS lo, max({value}) AS hi, median({value}) AS mid FROM {source} GROUP BY scene"
    VIEWS[f"{name}_bins"] = f"SELECT scene, lo, hi, least(floor(({value} - lo) / ((hi - lo) / 256)), 255)::INT AS bin, count(*) AS n FROM {source} JOIN {name}_spread USING (scene) WHERE hi > lo GROUP BY ALL"
    VIEWS[f"{name}_run"] = f"""SELECT scene, bin, centre, sum(share) OVER w AS omega, sum(share * centre) OVER w AS mu, sum(share * centre) OVER (PARTITION BY scene) AS total FROM (
        SELECT scene, bin, lo + (bin + 0.5) * ((hi - lo) / 256) AS centre, n / sum(n) OVER (PARTITION BY scene) AS share FROM {name}_bins) WINDOW w AS (PARTITION BY scene ORDER BY bin ROWS UNBOUNDED PRECEDING)"""
    VIEWS[f"{name}_best"] = f"""SELECT scene, first(centre ORDER BY between_ DESC NULLS LAST, bin) AS best FROM (
        SELECT *, round(CASE WHEN omega < 1 - 1e-12 THEN pow(total * omega - mu, 2) / (omega * (1 - omega)) END, 9) AS between_ FROM {name}_run) GROUP BY scene"""
    VIEWS[name] = f"SELECT scene, coalesce(best, mid) AS otsu FROM {name}_spread LEFT JOIN {name}_best USING (scene)"


otsu_view("ratio_otsu", "windows", "ratio_db")
VIEWS["thresholds"] = """SELECT scene, n AS windows, CASE WHEN reason IS NULL THEN p60 ELSE -15.0 END AS water_max_vv_db, CASE WHEN reason IS NULL THEN otsu ELSE -12.0 END AS water_max_ratio_db,
    -6.0 AS urban_min_vv_db, -8.0 AS urban_max_ratio_db, 0.55 AS volume_min_rvi, CASE WHEN reason IS NULL THEN 'fitted' ELSE 'fallback' END AS source, reason FROM (
    SELECT *, CASE WHEN n < 200 THEN 'too_few_windows' WHEN p60 >= -6 THEN 'classes_overlap' WHEN p95 - p05 < 8 THEN 'narrow_spread' END AS reason FROM (
        SELECT scene, count(*) AS n, quantile_cont(vv_db, 0.05) AS p05, quantile_cont(vv_db, 0.6) AS p60, quantile_cont(vv_db, 0.95) AS p95 FROM windows GROUP BY scene) JOIN ratio_otsu USING (scene))"""
MECHANISM_SQL = """CASE WHEN vv_db <= water_max_vv_db AND ratio_db <= water_max_ratio_db THEN 'smooth_surface' WHEN vv_db >= urban_min_vv_db AND ratio_db <= urban_max_ratio_db THEN 'double_bounce'
    WHEN rvi >= volume_min_rvi THEN 'volume' ELSE 'rough_surface' END"""
VIEWS["classified"] = f"SELECT *, {MECHANISM_SQL} AS mechanism FROM windows JOIN thresholds USING (scene)"
VIEWS["cells"] = """SELECT scene, r // 5 AS cell_row, c // 5 AS cell_col, count(*) AS pixels, count(*) FILTER (dn_vv > 0 AND dn_vh > 0) AS valid,
    CASE WHEN count(*) FILTER (dn_vv > 0 AND dn_vh > 0) / count(*) >= 0.5 THEN sum(dn_vv * dn_vv / 1e6) FILTER (dn_vv > 0 AND dn_vh > 0) / count(*) FILTER (dn_vv > 0 AND dn_vh > 0) END AS vv,
    CASE WHEN count(*) FILTER (dn_vv > 0 AND dn_vh > 0) / count(*) >= 0.5 THEN sum(dn_vh * dn_vh / 1e6) FILTER (dn_vv > 0 AND dn_vh > 0) / count(*) FILTER (dn_vv > 0 AND dn_vh > 0) END AS vh FROM pixels GROUP BY ALL"""
VIEWS["labels_map"] = f"""SELECT scene, cell_row, cell_col, CASE WHEN vv IS NULL THEN NULL ELSE list_position(['smooth_surface', 'double_bounce', 'volume', 'rough_surface'], {MECHANISM_SQL}) - 1 END AS label FROM (
    SELECT scene, cell_row, cell_col, vv, 10 * log10(greatest(vv, 1e-5)) AS vv_db, 10 * log10(greatest(vh, 1e-5)) - 10 * log10(greatest(vv, 1e-5)) AS ratio_db, CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) ELSE 0 END AS rvi FROM cells) JOIN thresholds USING (scene)"""
VIEWS["near_labels"] = """SELECT l.scene, l.cell_row, l.cell_col, l.label, n.label AS near_label, n.cell_row AS near_cell_row, n.cell_col AS near_cell_col FROM
    (SELECT l.*, least(greatest(cell_row + a, 0), mr) AS nr, least(greatest(cell_col + b, 0), mc) AS nc FROM labels_map l JOIN (SELECT scene, max(cell_row) AS mr, max(cell_col) AS mc FROM labels_map GROUP BY scene) USING (scene)
     CROSS JOIN (VALUES (-1), (0), (1)) AS x(a) CROSS JOIN (VALUES (-1), (0), (1)) AS y(b)) l JOIN labels_map n ON n.scene = l.scene AND n.cell_row = l.nr AND n.cell_col = l.nc"""
VIEWS["filtered"] = """SELECT m.scene, m.cell_row, m.cell_col, CASE WHEN m.label IS NOT NULL THEN best END AS label FROM labels_map m LEFT JOIN (
    SELECT scene, cell_row, cell_col, first(near_label ORDER BY n DESC, near_label) AS best FROM (SELECT scene, cell_row, cell_col, near_label, count(*) AS n FROM near_labels WHERE near_label IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (scene, cell_row, cell_col)"""


def scenes_sized(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with a raster size and a box, one per part."""
    p = read(spark, d, "part")
    return p.select(F.concat(F.lit("scene-"), F.col("p_partkey")).alias("scene"), (F.lit(100) + F.col("p_partkey") * 37 % 900).cast("int").alias("width"), (F.lit(100) + F.col("p_partkey") * 53 % 700).cast("int").alias("height"))


VIEWS["scenes_sized"] = "SELECT 'scene-' || p_partkey AS scene, (100 + p_partkey * 37 % 900)::INT AS width, (100 + p_partkey * 53 % 700)::INT AS height FROM part"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in degrees, one per supplier; some are turned round, some too large."""
    k = F.col("s_suppkey")
    west, south = (k * 7919 % 33000) / 100.0 - 165, (k * 104729 % 15000) / 100.0 - 75
    return read(spark, d, "supplier").select(k.alias("box"), west.alias("west"), south.alias("south"), (west + (k * 31 % 900) / 100.0 - 0.5).alias("east"), (south + (k * 17 % 700) / 100.0 - 0.3).alias("north"))


VIEWS["boxes"] = """SELECT s_suppkey AS box, west, south, west + (s_suppkey * 31 % 900) / 100.0 - 0.5 AS east, south + (s_suppkey * 17 % 700) / 100.0 - 0.3 AS north FROM (
    SELECT s_suppkey, (s_suppkey * 7919 % 33000) / 100.0::DOUBLE - 165 AS west, (s_suppkey * 104729 % 15000) / 100.0::DOUBLE - 75 AS south FROM supplier)"""


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to ``n`` places, for comparing engines that sum in another order."""
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
