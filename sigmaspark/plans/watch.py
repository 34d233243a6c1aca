"""Queries over streams and product sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archives, products
from ..sources.versioned import VersionedTable
from ..streaming import ordered, streams
from . import fixtures as fx
from .registry import VIEWS, query
from .store import _job_events  # noqa: F401

_GROUPS = ("uploads", "acquisitions", "jobs")


def _events(spark, d) -> DataFrame:
    group = F.element_at(F.array(*map(F.lit, _GROUPS)), (F.col("event_id") % 3 + 1).cast("int"))
    return streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("grp", group)


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("r01_rate_buckets", "SELECT epoch_us(date_trunc('minute', ts)) AS minute, user_id, ['uploads', 'acquisitions', 'jobs'][event_id % 3 + 1] AS grp, count(*) AS n, count(*) > CASE event_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 20 ELSE 120 END AS rejected FROM events GROUP BY date_trunc('minute', ts), user_id, event_id % 3")
def r01(spark, d):
    out = streams.run_once(streams.rate_buckets(_events(spark, d), "user_id", "grp"), "update", ["minute", "user_id", "grp"])
    return out.select(_micros("minute").alias("minute"), "user_id", "grp", "n", "rejected")


@query("r02_job_state_fold", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def r02(spark, d):
    return streams.run_once(streams.state_fold(_events(spark, d), "user_id", "event_id", ["event_type"]), "update", ["user_id"])


_BAD = """SELECT event_id, job, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY event_id) AS previous FROM jev) WHERE previous IS NOT NULL AND previous <> status AND NOT (
    (previous = 'queued' AND (status IN ('validating', 'failed', 'cancelled') OR (status = 'processing' AND kind = 'cleanup_scene'))) OR (previous = 'validating' AND status IN ('processing', 'failed', 'cancelled')) OR (previous = 'processing' AND status IN ('ready', 'failed', 'cancelled')))"""


def _job_statuses(events: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "validating", "processing", "ready", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", "ts", F.col("user_id").alias("job"), status.alias("status"), F.when(F.col("user_id") % 3 == 0, "cleanup_scene").otherwise("process_scene").alias("kind"))


@query("r03_transition_violations", _BAD, "jev")
def r03(spark, d):
    own = _job_statuses(_events(spark, d))
    return streams.run_once(ordered.transition_violations(own, "0 seconds"), "append").select("event_id", "job", "previous", "status")


def _sessions_sql(gap: int, delay: int) -> str:
    return f"""SELECT user_id, min(t) AS start, max(t) + {gap} AS "end", count(*) AS touches FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < {gap} THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s HAVING max(t) + {gap} <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - {delay}"""


@query("r04_lease_expiry", _sessions_sql(300_000_000, 60_000_000))
def r04(spark, d):
    out = streams.run_once(streams.sessions(_events(spark, d), "user_id", "300 seconds", "1 minute"), "append")
    return out.select("user_id", _micros("start").alias("start"), _micros("end").alias("end"), "touches")


@query("r06_idle_sessions", _sessions_sql(7_200_000_000, 600_000_000))
def r06(spark, d):
    out = streams.run_once(streams.sessions(_events(spark, d), "user_id", "2 hours", "10 minutes"), "append")
    return out.select("user_id", _micros("start").alias("start"), _micros("end").alias("end"), "touches")


@query("r05_redelivery_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def r05(spark, d):
    return streams.run_once(streams.deduplicate(_events(spark, d), ["user_id", "event_type"], "1 hour"), "append").select("user_id", "event_type")


@query("r07_incremental_ingest", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def r07(spark, d):
    own = lambda b: b.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    merge = lambda old, new: old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # several files in batches of one: each batch rewrites the buckets of its users only
    dealt = _files_in_order(fx.read(spark, d, "events").withColumn("batch", F.pmod(F.xxhash64("user_id"), F.lit(_ARRIVALS))), 1)
    table = VersionedTable(spark, streams.shared_path(spark)).create("user_id long, n long, total double", ["user_id"], 32)
    return streams.ingest(dealt, own, table, merge).select("user_id", "n", F.round("total", 4).alias("total"))


@query("r09_late_events", "SELECT epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS n FROM events WHERE event_id % 3 = user_id % 3 GROUP BY ALL")
def r09(spark, d):
    own = _events(spark, d).withColumn("holder", F.col("event_id") % 3).withColumn("current", F.col("user_id") % 3)
    out = streams.run_once(streams.current_holder(own, "5 minutes", "holder", "current"), "update", ["minute"])
    return out.select(_micros("minute").alias("minute"), "n")


# -- several files in another order than that of the events, some too late ------------

_ARRIVALS = 6
_DELAY_DAYS = 6
VIEWS["arrived"] = f"""SELECT *, least({_ARRIVALS - 1}, event_id * {_ARRIVALS} // (SELECT max(event_id) + 1 FROM events)
    + CASE WHEN event_id % 11 = 5 THEN 2 WHEN event_id % 7 = 3 THEN 1 ELSE 0 END) AS batch FROM events"""
# the watermark that drops rows of a batch is the one that the batch before it had
VIEWS["marks"] = "SELECT batch + 2 AS batch, max(max(epoch_us(ts)) // 1000) OVER (ORDER BY batch) AS seen FROM arrived GROUP BY batch"
VIEWS["final_mark"] = f"SELECT (max(epoch_us(ts)) // 1000 - {_DELAY_DAYS * 86_400_000}) * 1000 AS mark FROM arrived"
VIEWS["in_time"] = f"""SELECT arrived.* FROM arrived LEFT JOIN marks USING (batch)
    WHERE seen IS NULL OR epoch_us(ts) > (seen - {_DELAY_DAYS * 86_400_000}) * 1000"""


def _arrivals(spark, d) -> DataFrame:
    """The events in six batches of files: some rows come a batch later, some two, which can be too late."""
    e = fx.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.agg(F.max("event_id")).first()[0] + 1
    late = F.when(F.col("event_id") % 11 == 5, 2).when(F.col("event_id") % 7 == 3, 1).otherwise(0)
    dealt = e.withColumn("batch", F.least(F.lit(_ARRIVALS - 1), F.floor(F.col("event_id") * _ARRIVALS / n) + late))
    return _files_in_order(dealt)


def _files_in_order(dealt: DataFrame, files: int = 2) -> DataFrame:
    """A stream of the rows whose batches are those of the column ``batch``."""
    spark = dealt.sparkSession
    path = streams.shared_path(spark)
    for b in range(_ARRIVALS):
        dealt.where(F.col("batch") == b).drop("batch").repartition(files).write.parquet(f"{path}/{b}")
    return streams.file_stream(spark, path, dealt.drop("batch").schema, files)


VIEWS["jev_in_time"] = """SELECT event_id, user_id AS job, ['queued', 'validating', 'processing', 'ready', 'failed'][event_id % 5 + 1] AS status,
    CASE WHEN user_id % 3 = 0 THEN 'cleanup_scene' ELSE 'process_scene' END AS kind FROM in_time WHERE epoch_us(ts) // 1000 * 1000 <= (SELECT mark FROM final_mark )"""


@query("r03_violations_out_of_order", _BAD.replace("FROM jev)", "FROM jev_in_time )"), "jev_in_time")
def r03_out_of_order(spark, d):
    own = _job_statuses(_arrivals(spark, d))
    return streams.run_once(ordered.transition_violations(own, f"{_DELAY_DAYS} days"), "append").select("event_id", "job", "previous", "status")


_LEASE = 43_200
VIEWS["lease_events"] = """SELECT event_id, user_id AS task, 'w' || event_id % 2 AS worker, epoch_us(ts) AS us,
    CASE event_type WHEN 'purchase' THEN 'claim' WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'complete' ELSE 'renew' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM in_time WHERE epoch_us(ts) // 1000 * 1000 <= (SELECT mark FROM final_mark )"""
_LEASES = f"""SELECT task, event_id, worker, outcome, at_us FROM (
    WITH RECURSIVE run AS (
        SELECT DISTINCT task, 0::BIGINT AS n, NULL::VARCHAR AS holder, NULL::BIGINT AS expiry, NULL::BIGINT AS event_id, NULL::VARCHAR AS worker, NULL::VARCHAR AS outcome, NULL::BIGINT AS us, NULL::VARCHAR AS ended, NULL::BIGINT AS ended_at FROM lease_events
        UNION ALL
        SELECT task, n, CASE WHEN outcome IS NOT NULL THEN live WHEN kind = 'complete' THEN NULL ELSE worker END,
            CASE WHEN outcome IS NOT NULL THEN CASE WHEN live IS NOT NULL THEN expiry END WHEN kind <> 'complete' THEN us + {_LEASE * 1_000_000} END,
            event_id, worker, outcome, us, CASE WHEN live IS NULL THEN holder END, CASE WHEN live IS NULL AND holder IS NOT NULL THEN expiry END
        FROM (SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN live <> worker THEN 'refused' END WHEN live IS NULL OR live <> worker THEN 'lost' END AS outcome FROM (
            SELECT e.*, r.holder, r.expiry, CASE WHEN e.us < r.expiry THEN r.holder END AS live FROM run r JOIN lease_events e ON e.task = r.task AND e.n = r.n + 1)))
    SELECT task, event_id, worker, outcome, us AS at_us FROM run WHERE outcome IS NOT NULL
    UNION ALL SELECT task, NULL, ended, 'expired', ended_at FROM run WHERE ended IS NOT NULL
    UNION ALL SELECT task, NULL, holder, 'expired', expiry FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC) AS back FROM run) WHERE back = 1 AND holder IS NOT NULL AND expiry <= (SELECT mark FROM final_mark ))"""


@query("r04_lease_watch", _LEASES, "lease_events")
def r04_lease_watch(spark, d):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "claim").when(F.col("event_type") == "error", "complete").otherwise("renew")
    own = _arrivals(spark, d).select("event_id", "ts", F.col("user_id").alias("task"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("worker"), kind.alias("kind"))
    return streams.run_once(ordered.lease_watch(own, _LEASE, f"{_DELAY_DAYS} days"), "append")


_BATCH_US = 5 * 86_400_000_000
VIEWS["deliveries"] = f"""SELECT event_id, again, home, home + again AS batch, us + CASE WHEN again = 4 THEN {4 * _BATCH_US} ELSE 0 END AS us FROM (
    SELECT event_id, epoch_us(ts) AS us, event_id * {_ARRIVALS} // (SELECT max(event_id) + 1 FROM events) AS home FROM events)
    CROSS JOIN (VALUES (0), (1), (4)) AS a(again) WHERE home + again < {_ARRIVALS} AND (again = 0 OR (again = 1 AND event_id % 3 = 0) OR (again = 4 AND event_id % 5 = 0))"""
VIEWS["delivery_marks"] = "SELECT batch, max(max(us) // 1000) OVER (ORDER BY batch) AS seen FROM deliveries GROUP BY batch"


# an entry's state goes at the end of a batch, by what had been seen before that batch
@query("r05_redelivery_windows", f"""SELECT f.event_id, 1 + (m.seen IS NOT NULL)::BIGINT AS n FROM deliveries f LEFT JOIN deliveries l ON l.event_id = f.event_id AND l.again = 4
    LEFT JOIN delivery_marks m ON m.batch = l.batch - 2 AND f.us // 1000 + {_DELAY_DAYS * 86_400_000} <= m.seen - {_DELAY_DAYS * 86_400_000} WHERE f.again = 0""", "deliveries delivery_marks")
def r05_redelivery_windows(spark, d):
    """Every entry comes once, some again a batch later (inside the delay), some four batches later (beyond it: they count anew)."""
    e = fx.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    n = e.agg(F.max("event_id")).first()[0] + 1
    home = F.floor(F.col("event_id") * _ARRIVALS / n)
    again = F.explode(F.filter(F.array(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1), F.when(F.col("event_id") % 5 == 0, 4)), lambda x: x.isNotNull())).alias("again")
    dealt = e.select("*", home.alias("home"), again).withColumn("batch", F.col("home") + F.col("again")).where(F.col("batch") < _ARRIVALS)
    # a delivery that comes again keeps the time of its entry inside the delay, and has a new one beyond it
    at = F.when(F.col("again") == 4, F.timestamp_micros(F.unix_micros("ts") + 4 * _BATCH_US)).otherwise(F.col("ts"))
    once = streams.deduplicate(_files_in_order(dealt.select("event_id", at.alias("ts"), "batch")), ["event_id"], f"{_DELAY_DAYS} days")
    return streams.run_once(once, "append").groupBy("event_id").agg(F.count("*").alias("n"))


@query("r09_late_events_dropped", f"""SELECT epoch_us(date_trunc('minute', ts)) AS minute, count(*) AS n FROM arrived LEFT JOIN marks USING (batch)
    WHERE event_id % 3 = user_id % 3 AND (seen IS NULL OR epoch_us(date_trunc('minute', ts)) + 60000000 > (seen - {_DELAY_DAYS * 86_400_000}) * 1000) GROUP BY ALL""", "arrived marks")
def r09_late_events_dropped(spark, d):
    own = _arrivals(spark, d).withColumn("holder", F.col("event_id") % 3).withColumn("current", F.col("user_id") % 3)
    out = streams.run_once(streams.current_holder(own, f"{_DELAY_DAYS} days", "holder", "current"), "update", ["minute"])
    return out.select(_micros("minute").alias("minute"), "n")


# -- archives -----------------------------------------------------------------------

def _archives(spark, d) -> DataFrame:
    """Small archives made from the parts, a few members each."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["p_partkey"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr(f"P{k}.SAFE/manifest.safe", "x" * int(k % 50 + 1))
                    for n in range(int(k % 4)):
                        z.writestr(f"P{k}.SAFE/measurement/s1-{'vv' if n == 0 else 'vh'}-{n}.tiff", b"II*\0")
                    if k % 5 == 0:
                        z.writestr(f"P{k}.SAFE/extra.tif", b"II*\0")
                out.append((f"a{k}", held.getvalue() if k % 7 else b"broken"))
            yield pd.DataFrame(out, columns=["path", "content"])

    return fx.spread(fx.read(spark, d, "part").select("p_partkey")).mapInPandas(make, "path string, content binary")


@query("s01_archive_members", "SELECT 'a' || k AS archive, (1 + k % 4 + (k % 5 = 0)::INT)::BIGINT AS members, k % 50 + 1 + 4 * (k % 4 + (k % 5 = 0)::INT) AS bytes FROM (SELECT p_partkey AS k FROM part) WHERE k % 7 <> 0")
def s01(spark, d):
    return archives.archive_members(_archives(spark, d)).groupBy("archive").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


@query("s01_measurements", "SELECT 'a' || k AS archive, CASE WHEN k % 4 > 0 THEN k % 4 ELSE 1 END::INT AS rasters, k % 4 <= 2 AS usable FROM (SELECT p_partkey AS k FROM part) WHERE k % 7 <> 0 AND (k % 4 > 0 OR k % 5 = 0)")
def s01_measurements(spark, d):
    return archives.measurements(archives.archive_members(_archives(spark, d))).select("archive", F.size("rasters").alias("rasters"), "usable")


@query("f15_magic_bytes", "SELECT p_partkey, ['zip', 'tiff', 'json', NULL][p_partkey % 4 + 1] AS kind FROM part")
def f15(spark, d):
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, F.unhex(F.lit("504B030400"))).when(k == 1, F.unhex(F.lit("49492A0000"))).when(k == 2, F.unhex(F.lit("EFBBBF20207B"))).otherwise(F.unhex(F.lit("00010203")))
    return fx.read(spark, d, "part").select("p_partkey", archives.magic_kind(content).alias("kind"))


VIEWS["members"] = """SELECT l_orderkey AS archive, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 <> 0 THEN 'p/manifest.safe' WHEN l_quantity = 13 THEN '../x' ELSE 'p/f' || l_linenumber END AS name, (l_extendedprice)::BIGINT AS size,
    CASE WHEN l_quantity = 17 THEN 1 ELSE (l_extendedprice / 3)::BIGINT END AS compressed, CASE WHEN l_quantity = 19 THEN 1 ELSE 0 END AS flags, CASE WHEN l_quantity = 23 THEN 40960 ELSE 33188 END AS mode FROM lineitem"""


@query("f16_archive_safety", """SELECT archive, CASE WHEN bool_or(name = '../x') THEN 'path' WHEN bool_or(flags = 1) THEN 'encrypted' WHEN bool_or(mode = 40960) THEN 'symlink' WHEN bool_or(size > 0 AND (compressed <= 0 OR size > 100 * compressed)) THEN 'ratio' WHEN NOT bool_or(name LIKE '%manifest.safe') THEN 'manifest' END AS reason FROM members GROUP BY archive""", "members")
def f16(spark, d):
    q = F.col("l_quantity")
    name = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 != 0), "p/manifest.safe").when(q == 13, "../x").otherwise(F.concat(F.lit("p/f"), F.col("l_linenumber")))
    m = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), name.alias("name"), F.round("l_extendedprice", 0).cast("bigint").alias("size"), F.when(q == 17, 1).otherwise(F.round(F.col("l_extendedprice") / 3, 0).cast("bigint")).alias("compressed"), F.when(q == 19, 1).otherwise(0).alias("flags"), F.when(q == 23, 40960).otherwise(33188).cast("bigint").alias("mode"))
    return archives.safety_reason(m)


@query("f17_safe_layout", "SELECT p_partkey AS archive, CASE WHEN k % 7 = 0 THEN 'manifest' WHEN k % 5 = 0 THEN 'measurements' WHEN k % 3 = 0 THEN 'bands' WHEN k % 11 = 0 THEN 'noise' END AS reason FROM (SELECT p_partkey, p_partkey AS k FROM part)")
def f17(spark, d):
    k = F.col("p_partkey")
    name = lambda c, n: F.when(c, n)
    vv, vh = F.lit("p/measurement/s1a-iw-grd-vv-1.tiff"), F.when(k % 3 == 0, "p/measurement/s1a-iw-grd-vv-2.tiff").otherwise("p/measurement/s1a-iw-grd-vh-2.tiff")
    names = F.array(name(k % 7 != 0, "p/manifest.safe"), vv, name(k % 5 != 0, vh), *[F.lit(f"p/annotation/calibration/calibration-s1a-{p}-1.xml") for p in ("vv", "vh")], F.lit("p/annotation/calibration/noise-s1a-vv-1.xml"), name(k % 11 != 0, "p/annotation/calibration/noise-s1a-vh-1.xml"))
    m = fx.read(spark, d, "part").select(k.alias("archive"), F.explode(names).alias("name")).where("name is not null")
    return archives.layout_reason(m)


# -- XML ----------------------------------------------------------------------------

@query("s02_manifest_metadata", "SELECT c_custkey AS scene, 'S1' || (1 + c_custkey % 2) AS sensor, CASE WHEN c_custkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit_pass, 'VV,VH' AS polarisations FROM customer")
def s02(spark, d):
    k = F.col("c_custkey")
    xml = F.concat(F.lit("<m><name>n</name><familyName>S1</familyName><number>"), 1 + k % 2, F.lit("</number><pass>"), F.when(k % 2 == 0, "ASCENDING").otherwise("DESCENDING"), F.lit("</pass><startTime>2024-01-01T00:00:00</startTime><polarisation>VV</polarisation><polarisation>VH</polarisation><polarisation>VV</polarisation></m>"))
    return products.manifest_metadata(fx.read(spark, d, "customer").select(k.alias("scene"), xml.alias("value"))).select("scene", "sensor", "orbit_pass", "polarisations")


@query("s03_product_is_grd", "SELECT c_custkey AS scene, c_custkey % 3 = 0 AS grd FROM customer")
def s03(spark, d):
    text = F.concat(F.lit("<x><s1:productType>"), F.when(F.col("c_custkey") % 3 == 0, "GRD").otherwise("SLC"), F.lit("</s1:productType></x>"))
    return fx.read(spark, d, "customer").select(F.col("c_custkey").alias("scene"), products.is_grd(text).alias("grd"))


@query("s04_calibration_nodes", "SELECT c_custkey AS scene, line, pixel, (100 + c_custkey % 10 + line + pixel)::DOUBLE AS a FROM customer, (VALUES (0::BIGINT), (100)) l(line), (VALUES (0::BIGINT), (40)) p(pixel) WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0")
def s04(spark, d):
    k = F.col("c_custkey")
    row = lambda line, pixel: F.concat(F.lit(f"<calibrationVector><line>{line}</line><pixel count='2'>"), pixel, F.lit("</pixel><sigmaNought count='2'>"), F.when(k % 7 == 0, "0").otherwise((100 + k % 10 + line).cast("string")), F.lit(" "), 140 + k % 10 + line, F.lit("</sigmaNought></calibrationVector>"))
    xml = F.concat(F.lit("<c><adsHeader><polarisation>VV</polarisation></adsHeader><calibrationVectorList>"), row(0, F.lit("0 40")), row(100, F.when(k % 4 == 0, "0 50").otherwise("0 40")), F.lit("</calibrationVectorList></c>"))
    return products.calibration_nodes(fx.read(spark, d, "customer").select(k.alias("scene"), xml.alias("value"))).select("scene", "line", "pixel", "a")


@query("s05_noise_nodes", "SELECT c_custkey AS scene, 2::BIGINT AS nodes, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS blocks FROM customer")
def s05(spark, d):
    k = F.col("c_custkey")
    xml = F.concat(F.lit("<n><adsHeader><polarisation>VH</polarisation></adsHeader><noiseRangeVectorList><noiseRangeVector><line>0</line><pixel>0 100</pixel><noiseRangeLut>0 200</noiseRangeLut></noiseRangeVector></noiseRangeVectorList><noiseAzimuthVectorList><noiseAzimuthVector><swath>IW1</swath><firstRangeSample>0</firstRangeSample><lastRangeSample>49</lastRangeSample><line>0 100</line><noiseAzimuthLut>"), F.when(k % 3 == 0, "2").otherwise("2 2"), F.lit("</noiseAzimuthLut></noiseAzimuthVector></noiseAzimuthVectorList></n>"))
    nodes, blocks = products.noise_nodes(fx.spread(fx.read(spark, d, "customer").select(k)).select(k.alias("scene"), xml.alias("value")))
    n = nodes.groupBy("scene").agg(F.count("*").alias("nodes"))
    return n.join(blocks.groupBy("scene").agg(F.count("*").alias("b")), "scene", "left").select("scene", "nodes", F.coalesce("b", F.lit(0).cast("long")).alias("blocks"))


@query("a18_incidence_mean", "SELECT c_custkey AS archive, round((30.0 + c_custkey % 10 + 40.0) / 2, 2) AS incidence FROM customer")
def a18(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("<a><incidenceAngle>"), 30 + k % 10, F.lit(".0</incidenceAngle><incidenceAngle>40.0</incidenceAngle></a>"))
    c = fx.read(spark, d, "customer").select(k.alias("archive"), text.alias("text"), F.explode(F.array(F.lit("p/annotation/a.xml"), F.lit("p/annotation/calibration/c.xml"))).alias("name"))
    return products.incidence_mean(c)
