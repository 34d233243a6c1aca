"""Queries over questions, answers and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, detections, evidence, routing, scattering
from . import fixtures as fx
from .measure import _windows
from .registry import VIEWS, query
from .scenes import _valid

# Phrases that start the conversations' texts, so that every route occurs
_PHRASES = ["How many bridges are here?", "Where is the bridge", "Is there vegetation near the coast", "describe the scene", "find similar patches", "What is this", "Any vessels?", "storage tanks count", "overview of where ships are", "tell me more"]
_LIST = "[" + ", ".join("'" + p + "'" for p in _PHRASES) + "]"
_LABELS = ["Storage Tanks", "glasses", "quarries"]


def _questions(spark, d) -> DataFrame:
    c = fx.read(spark, d, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(_PHRASES) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(phrase, F.lit("  "), F.coalesce("text", F.lit(""))).alias("q"), F.array(*map(F.lit, _LABELS)).alias("labels"))


VIEWS["questions"] = f"SELECT conv_id, turn, {_LIST}[(conv_id * 7 + turn * 3) % {len(_PHRASES)} + 1] || '  ' || coalesce(text, '') AS q FROM conversations"
VIEWS["nq"] = "SELECT conv_id, turn, q, trim(regexp_replace(lower(q), '[\\s\\x0B]+', ' ', 'g')) AS n FROM questions"
VIEWS["qwords"] = "SELECT *, regexp_extract_all(n, '([a-z0-9]+)', 1) AS ws FROM nq"
_ALIAS = "CASE " + " ".join(f"WHEN list_has_any(ws, {names!r}) THEN '{name}'" for name, names in routing.ALIASES.items()) + " END"
VIEWS["targets"] = f"SELECT *, coalesce({_ALIAS}, CASE WHEN list_contains(ws, 'storage') AND list_contains(ws, 'tank') THEN 'storage tank' WHEN list_contains(ws, 'glasse') THEN 'glasse' WHEN list_contains(ws, 'quarry') THEN 'quarry' END) AS target FROM qwords"
_ENV = " OR ".join(f"contains(n, '{t}')" for t in routing.ENVIRONMENT)


def _re(p: str) -> str:
    return p.replace("'", "''")


VIEWS["intents"] = f"""SELECT *, CASE WHEN target IS NOT NULL THEN CASE WHEN regexp_matches(n, '{_re(routing.COUNT)}') THEN 'detector_count' WHEN regexp_matches(n, '{_re(routing.VISUAL)}') THEN 'detector_location' ELSE 'detector_presence' END
    WHEN {_ENV} THEN 'environment' WHEN regexp_matches(n, '{_re(routing.DESCRIBE)}') THEN 'scene_description' WHEN regexp_matches(n, '{_re(routing.VISUAL)}') THEN 'visual_evidence' ELSE 'scene_description' END AS intent FROM targets"""
_MACRO, _MICRO = (" OR ".join(f"contains(lower(q), '{p}')" for p in ps) for ps in (routing.MACRO, routing.MICRO))
VIEWS["routes"] = f"SELECT conv_id, turn, q, CASE WHEN ({_MACRO}) AND ({_MICRO}) THEN 'hybrid' WHEN {_MACRO} THEN 'macro' WHEN {_MICRO} THEN 'micro' ELSE 'none' END AS keyword, ['fail_floor', 'flat', 'steep'][turn % 3 + 1] AS spread FROM questions"
VIEWS["resolved"] = "SELECT *, CASE WHEN spread = 'fail_floor' THEN 'macro' WHEN keyword = 'hybrid' OR spread = 'flat' THEN 'hybrid' ELSE 'micro' END AS route FROM routes"


@query("x23_normalize_query", "SELECT conv_id, turn, n FROM nq", "nq")
def x23(spark, d):
    return _questions(spark, d).select("conv_id", "turn", routing.normalize_query(F.col("q")).alias("n"))


@query("x24_filter_fingerprint", """SELECT c_custkey, sha256('{"nation":"' || c_nationkey || '"' || coalesce(',"sensor":"' || lower(c_mktsegment) || '"', '') || '}') AS fingerprint FROM customer""")
def x24(spark, d):
    filters = F.create_map(F.lit("sensor"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("after"), F.lit(None).cast("string"))
    return fx.read(spark, d, "customer").select("c_custkey", routing.fingerprint(filters).alias("fingerprint"))


@query("x25_normalize_label", """SELECT p_partkey, CASE WHEN n LIKE '%ies' AND length(n) > 3 THEN substr(n, 1, length(n) - 3) || 'y' WHEN n LIKE '%s' AND n NOT LIKE '%ss' AND length(n) > 3 THEN substr(n, 1, length(n) - 1) ELSE n END AS label FROM (
    SELECT p_partkey, lower(['Quarries', 'Glass', 'Bridges', 'Bus', 'tank'][p_partkey % 5 + 1]) AS n FROM part)""")
def x25(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("Quarries", " Glass ", "Bridges", "Bus", "tank"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return fx.read(spark, d, "part").select("p_partkey", routing.normalize_label(names).alias("label"))


@query("x26_object_target", "SELECT conv_id, turn, target FROM targets", "targets")
def x26(spark, d):
    return _questions(spark, d).select("conv_id", "turn", routing.object_target(F.col("q"), F.col("labels")).alias("target"))


@query("x27_query_intent", "SELECT conv_id, turn, intent FROM intents", "intents")
def x27(spark, d):
    return _questions(spark, d).select("conv_id", "turn", routing.query_intent(F.col("q"), F.col("labels")).alias("intent"))


_CACHED = " OR ".join(f"contains(lower(q), '{p}')" for p in routing.CACHED)


@query("x28_keyword_route", f"SELECT conv_id, turn, keyword, {_CACHED} AS cached FROM routes", "routes")
def x28(spark, d):
    return _questions(spark, d).select("conv_id", "turn", routing.keyword_route(F.col("q")).alias("keyword"), routing.cached_macro(F.col("q")).alias("cached"))


def _routed(spark, d) -> DataFrame:
    spread = F.element_at(F.array(*map(F.lit, ("fail_floor", "flat", "steep"))), (F.col("turn") % 3 + 1).cast("int"))
    return routing.resolve_routes(_questions(spark, d).withColumn("keyword", routing.keyword_route(F.col("q"))).withColumn("spread", spread))


@query("x29_resolve_route", f"SELECT conv_id, turn, route, CASE WHEN route IN ('macro', 'hybrid') AND conv_id % 4 = 0 THEN 'micro' WHEN route = 'macro' AND ({_CACHED}) THEN 'macro_cached' WHEN route = 'macro' THEN 'macro_live' ELSE route END AS mode FROM resolved", "resolved")
def x29(spark, d):
    return _routed(spark, d).select("conv_id", "turn", "route", routing.final_mode(F.col("route"), F.col("conv_id") % 4 == 0, routing.cached_macro(F.col("q"))).alias("mode"))


@query("x33_evidence_availability", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'unavailable' END AS status FROM orders")
def x33(spark, d):
    s = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "pending").otherwise("odd")
    return fx.read(spark, d, "orders").select("o_orderkey", evidence.availability(s).alias("status"))


@query("x35_sha256_base64_hex", "SELECT c_custkey, sha256(c_name) AS hex FROM customer")
def x35(spark, d):
    from ..functions.digests import base64_to_hex

    return fx.read(spark, d, "customer").select("c_custkey", base64_to_hex(F.base64(F.unhex(F.sha2("c_name", 256)))).alias("hex"))


VIEWS["requests"] = "SELECT event_id, user_id, ts, event_type, value, '/api/v1/' || ['uploads', 'acquisitions', 'jobs', 'scenes', 'projects', 'other'][event_id % 6 + 1] || '/' || user_id AS path FROM events"
_FOLD = "CASE " + " ".join(f"WHEN starts_with(path, '/api/v1/{g}') THEN '/api/v1/{g}'" for g in ("uploads", "acquisitions", "jobs", "scenes", "projects")) + " ELSE path END"


def _requests(spark, d) -> DataFrame:
    group = F.element_at(F.array(*map(F.lit, ("uploads", "acquisitions", "jobs", "scenes", "projects", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    return fx.read(spark, d, "events").withColumn("path", F.concat(F.lit("/api/v1/"), group, F.lit("/"), F.col("user_id")))


@query("x37_path_fold", f"SELECT event_id, {_FOLD} AS path_group FROM requests", "requests")
def x37(spark, d):
    return _requests(spark, d).select("event_id", routing.path_fold(F.col("path")).alias("path_group"))


@query("a22_request_metrics", f"SELECT {_FOLD} AS path_group, event_type AS status, count(*) AS n, round(sum(value), 4) AS seconds FROM requests GROUP BY ALL", "requests")
def a22(spark, d):
    return _requests(spark, d).groupBy(routing.path_fold(F.col("path")).alias("path_group"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"))


# -- histories ----------------------------------------------------------------------

def _messages(spark, d) -> DataFrame:
    """The conversations' turns, three texts long."""
    c = fx.read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("conversation"), "turn", "role", F.repeat(F.coalesce("text", F.lit("")), F.lit(12)).alias("content"), F.lit("complete").alias("status"))


VIEWS["messages"] = "SELECT conv_id AS conversation, turn, role, repeat(coalesce(text, ''), 12) AS content FROM conversations"
VIEWS["recent"] = "SELECT *, substr(content, 1, 2000) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY turn DESC) AS n FROM messages) WHERE n <= 12 AND role IN ('user', 'assistant')"


@query("w06_history_budget", "SELECT conversation, turn, role, substr(cut, 1, room::INT) AS content FROM (SELECT *, 6000 - coalesce(sum(length(cut)) OVER (PARTITION BY conversation ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM recent) WHERE room > 0", "recent")
def w06(spark, d):
    return evidence.history(_messages(spark, d))


@query("w16_history_echo_drop", "SELECT conversation, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY turn DESC) AS n FROM messages) WHERE NOT (n = 1 AND role = 'user' AND conversation % 2 = 0)", "messages")
def w16(spark, d):
    m = _messages(spark, d)
    asked = evidence.newest(m, "conversation", "turn", "role").where("conversation % 2 = 0").select("conversation", F.col("content").alias("question"))
    return evidence.drop_echo(m, asked).select("conversation", "turn", "role")


@query("f21_bounded_text_json", "SELECT conv_id, turn, nullif(substr(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')), 1, 80), '') AS short FROM conversations")
def f21(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", evidence.bounded_text(F.col("text"), 80).alias("short"))


@query("f22_citation_parse", "SELECT user_id, least(count(*) FILTER (event_id % 3 <> 0), 100) AS citations FROM events GROUP BY user_id")
def f22(spark, d):
    from ..sources.citations import parse_citations

    entry = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.lit("patch").alias("source_type"), F.col("event_id").cast("string").alias("source_id")))).otherwise('{"source_type": 5')
    lists = fx.read(spark, d, "events").select("user_id", entry.alias("j")).groupBy("user_id").agg(F.collect_list("j").alias("entries"))
    return parse_citations(lists, "entries").select("user_id", F.size("citations").cast("long").alias("citations"))


VIEWS["cites"] = """SELECT user_id AS scene, 0 AS kind, 'patch' AS source_type, event_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = 'click'
    UNION ALL SELECT user_id, 1, 'metadata', event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, 2, 'overview', event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events WHERE event_type = 'purchase'"""


@query("u01_citation_union", "SELECT scene, source_type, source_id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY kind, rank, source_id) AS position FROM cites WHERE kind < 2 OR rank <= 2) WHERE position <= 100", "cites")
def u01(spark, d):
    from pyspark.sql import Window

    e = fx.read(spark, d, "events")
    part = lambda kind, name: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("scene"), F.lit(name).alias("source_type"), F.col("event_id").alias("source_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    return evidence.citation_union([(part("click", "patch"), None), (part("view", "metadata"), None), (part("purchase", "overview"), 2)])


@query("u02_scene_id_union", "SELECT query, scene, row_number() OVER (PARTITION BY query ORDER BY p, scene)::INT AS position FROM (SELECT query, scene, min(p) AS p FROM (SELECT o_custkey AS query, o_orderkey % 7 AS scene, o_orderkey AS p FROM orders UNION ALL SELECT c_custkey, c_nationkey, 1099511627776 FROM customer) GROUP BY ALL)")
def u02(spark, d):
    cards = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 7).alias("scene"), F.col("o_orderkey").alias("rank"))
    return evidence.scene_union(cards, fx.read(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.col("c_nationkey").alias("scene")))


@query("n04_context_text", "SELECT user_id AS scene, substr(string_agg('EVENT ' || event_id || ' ' || event_type, chr(10) ORDER BY event_id), 1, 400) AS text FROM events GROUP BY user_id")
def n04(spark, d):
    lines = fx.read(spark, d, "events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("position"), F.concat(F.lit("EVENT "), F.col("event_id"), F.lit(" "), F.col("event_type")).alias("line"))
    return evidence.context_text(lines, 400)


# -- answers ------------------------------------------------------------------------

VIEWS["asked"] = f"SELECT conv_id, turn, target, intent, regexp_matches(n, '{_re(routing.COUNT)}') AS counting, regexp_matches(n, '{_re(routing.VISUAL)}') AS locating FROM intents"
VIEWS["stats"] = "SELECT 'bridge' AS target, count(*) AS matches, min(confidence) AS low, max(confidence) AS high, string_agg(DISTINCT region, ', ' ORDER BY region) AS regions FROM regions WHERE label = 'brand#13'"


@query("n01_detector_answer", """SELECT conv_id, turn, CASE WHEN a.target IS NULL THEN NULL WHEN coalesce(matches, 0) > 0 THEN CASE WHEN counting THEN 'Detector record: ' ELSE 'Yes, detector record: ' END || matches || ' ' || a.target || CASE WHEN matches = 1 THEN ' candidate' ELSE ' candidates' END || '.'
    || ' Confidence ' || round_even(low * 100, 0)::INT || '% to ' || round_even(high * 100, 0)::INT || '%.' || CASE WHEN locating AND regions <> '' THEN ' Regions: ' || regions || '.' ELSE '' END
    WHEN conv_id % 2 = 0 THEN 'Undecided: no detector has run for ' || a.target || '.' ELSE 'No ' || a.target || ' recorded; that doesn''t prove absence.' END AS answer FROM asked a LEFT JOIN stats USING (target)""", "asked stats")
def n01(spark, d):
    found = _valid(spark, d).where("label = 'brand#13'").withColumn("label", F.lit("bridge")).withColumn("scene", F.lit("s"))
    wanted = found.sparkSession.createDataFrame([("q", "s", "bridge")], "question string, scene string, label string")
    stats = detections.answer_stats(wanted, found).select(F.col("label").alias("target"), "matches", "low", "high", "regions")
    q = _questions(spark, d)
    n = routing.normalize_query(F.col("q"))
    asked = q.select("conv_id", "turn", routing.object_target(F.col("q"), F.col("labels")).alias("target"), n.rlike(routing.COUNT).alias("counting"), n.rlike(routing.VISUAL).alias("locating")).join(F.broadcast(stats), "target", "left")
    status = F.when(F.col("conv_id") % 2 == 0, "awaiting_detector_output").otherwise("completed")
    c = F.col
    return asked.select("conv_id", "turn", answers.detector_answer(c("target"), status, F.coalesce("matches", F.lit(0)), c("low"), c("high"), c("regions"), c("counting"), c("locating")).alias("answer"))


VIEWS["mech_text"] = "SELECT 'Measured scattering: ' || string_agg(round_even(fraction * 100, 0)::INT || '% ' || mechanism, '; ' ORDER BY fraction DESC, mechanism) || '.' AS s FROM block WHERE n > 0 AND scene = 'fitted'"
_TERM = "CASE " + " ".join(f"WHEN contains(n, '{t}') THEN '{t}'" for t in routing.ENVIRONMENT) + " ELSE 'that environment class' END"


def _mechanisms(spark, d) -> DataFrame:
    block = scattering.mechanism_block(_windows(spark, d)).where("scene = 'fitted'")
    return block.groupBy().agg(F.collect_list(F.struct("mechanism", F.col("fraction"))).alias("mechanisms"))


@query("n02_environment_answer", f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'Land cover: forest, water.' WHEN turn % 5 = 1 THEN 'Classes withheld, outside the model''s region. ' || s WHEN turn % 5 = 2 THEN 'Classes withheld, location unknown. ' || s
    WHEN turn % 5 = 3 THEN 'No class can be named for ' || {_TERM} || '. ' || s ELSE 'Cannot confirm ' || {_TERM} || '. Brightness suggests mostly water.' END AS answer FROM nq, mech_text""", "nq mech_text")
def n02(spark, d):
    kind = F.col("turn") % 5
    status = F.when(kind == 0, "available").when(kind == 1, "out_of_domain").when(kind == 2, "domain_unverified").otherwise("unavailable")
    none = F.expr("cast(array() as array<struct<mechanism:string,fraction:double>>)")
    q = _questions(spark, d).crossJoin(F.broadcast(_mechanisms(spark, d)))  # one row of mechanisms
    own = F.when(kind == 4, none).otherwise(F.col("mechanisms"))
    return q.select("conv_id", "turn", answers.environment_answer(routing.environment_term(F.col("q")), status, F.array(F.lit("forest"), F.lit("water")), own, F.lit("likely_water_dominant")).alias("answer"))


@query("t06_mechanisms_ranked", "SELECT scene, string_agg(mechanism, ',' ORDER BY fraction DESC, mechanism) AS ranked FROM block WHERE n > 0 GROUP BY scene", "block")
def t06(spark, d):
    m = scattering.mechanism_block(_windows(spark, d)).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("f"), "mechanism"))).alias("m"))
    return m.select("scene", F.array_join(F.transform("m", lambda x: x["mechanism"]), ",").alias("ranked"))


@query("t05_top_classes", "SELECT scene, class FROM (SELECT scene, class, row_number() OVER (PARTITION BY scene ORDER BY s DESC, m DESC, class) AS n FROM (SELECT scene, (i - 1)::INT AS class, round(avg(p), 9) AS m, avg((p >= 0.95)::INT) AS s FROM (SELECT label::VARCHAR AS scene, unnest(range(1, len(embedding) + 1)) AS i, unnest(list_transform(embedding, lambda x: 1 / (1 + exp(-40 * x::DOUBLE)))) AS p FROM embeddings) GROUP BY ALL) WHERE s >= 0.05) WHERE n <= 4")
def t05(spark, d):
    from pyspark.sql import Window

    from ..operators import context
    from .measure import _scores

    order = Window.partitionBy("scene").orderBy(F.desc("present_share"), F.desc(F.round("mean_probability", 9)), "class")
    return context.scene_classes(_scores(spark, d)).withColumn("n", F.row_number().over(order)).where("n <= 4").select("scene", "class")


@query("n03_scene_description", """SELECT c_custkey, concat_ws(chr(10) || chr(10), coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END, 'Unknown sensor') || ' scene, taken 2024-01-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 2 = 0 THEN ', ascending pass' ELSE '' END || ', VV/VH.',
    CASE WHEN c_custkey % 3 <> 0 THEN 'Centre 1.00°N, 2.00°E, about 250 x 170 km.' END, 'Water-like brightness on ' || c_custkey % 100 || '%.', CASE WHEN c_custkey % 5 <> 0 THEN 'Detections: ship (' || c_custkey % 5 || ').' END, 'Everything above is measured or detector-backed.') AS text FROM customer""")
def n03(spark, d):
    k = F.col("c_custkey")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    none = F.expr("cast(array() as array<struct<mechanism:string,fraction:double>>)")
    text = answers.scene_description(F.when(k % 6 != 0, F.col("c_mktsegment")), day, F.when(k % 2 == 0, "ascending"), F.lit("VV/VH"), F.when(k % 3 != 0, "1.00°N, 2.00°E"), F.lit(250.2), F.lit(170.4), k % 100 / 100.0, F.when(k % 5 != 0, F.concat(F.lit("ship ("), k % 5, F.lit(")"))), none)
    return fx.read(spark, d, "customer").select("c_custkey", text.alias("text"))


@query("n05_scene_first_route", """SELECT conv_id, turn, CASE WHEN has AND (intent LIKE 'detector%' OR intent = 'environment') THEN 'direct' WHEN NOT has AND state = 'empty' THEN 'insufficient' WHEN intent = 'visual_evidence' AND state IN ('empty', 'weak') THEN 'insufficient' WHEN intent = 'scene_description' AND has THEN 'described' ELSE 'retrieve' END AS path FROM (
    SELECT *, conv_id % 3 <> 0 AS has, ['empty', 'weak', 'results'][turn % 3 + 1] AS state FROM intents)""", "intents")
def n05(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("empty", "weak", "results"))), (F.col("turn") % 3 + 1).cast("int"))
    return _questions(spark, d).select("conv_id", "turn", answers.answer_route(routing.query_intent(F.col("q"), F.col("labels")), F.col("conv_id") % 3 != 0, state).alias("path"))


@query("n07_evidence_sections", "SELECT c_custkey, 1 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT AS sections, c_mktsegment AS sensor FROM customer")
def n07(spark, d):
    k = F.col("c_custkey")
    section = lambda name, body: F.struct(F.lit(name).alias("kind"), body.cast("string").alias("body"))
    sections = F.filter(F.array(section("metadata", F.col("c_mktsegment")), F.when(k % 2 == 0, section("land_water", F.lit("mixed"))), F.when(k % 3 == 0, section("detector", F.lit("completed")))), lambda s: s.isNotNull())
    return fx.read(spark, d, "customer").select("c_custkey", F.size(sections).alias("sections"), sections[0]["body"].alias("sensor"))


@query("n06_scene_record", """SELECT scene, '1.0' AS schema_version, label, round(w, 6) AS water_fraction, mechanisms, first_mechanism, round(f, 6) AS first_fraction FROM (
    SELECT scene, CASE WHEN w >= 0.7 THEN 'likely_water_dominant' WHEN w <= 0.3 THEN 'likely_land_dominant' WHEN w IS NOT NULL THEN 'mixed_or_indeterminate' ELSE 'indeterminate' END AS label, w FROM mag_stats
        LEFT JOIN (SELECT scene, avg((x <= otsu)::INT) AS w FROM mag_clipped JOIN mag_otsu USING (scene) GROUP BY ALL) USING (scene))
    LEFT JOIN (SELECT scene, count(*)::INT AS mechanisms, min(mechanism) AS first_mechanism, arg_min(fraction, mechanism) AS f FROM block WHERE n > 0 GROUP BY scene) USING (scene)""", "mag_stats mag_clipped mag_otsu block")
def n06(spark, d):
    from ..operators import context

    lw = context.land_water(fx.pixels(spark, d), ["dn_vv", "dn_vh"]).select("scene", F.struct("label", "water_fraction", "threshold_db").alias("land_water"))
    block = scattering.mechanism_block(_windows(spark, d)).groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("mechanism", "fraction", "median_vv_db"))).alias("scattering"))
    record = lw.join(block, "scene", "left").select("scene", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "land_water", "scattering")).alias("record"))
    r = F.from_json("record", "schema_version string, land_water struct<label string, water_fraction double>, scattering array<struct<mechanism string, fraction double>>").alias("r")
    first = F.get("r.scattering", F.lit(0))
    return record.select("scene", r).select("scene", "r.schema_version", "r.land_water.label", F.round("r.land_water.water_fraction", 6).alias("water_fraction"), F.when(F.col("r.scattering").isNotNull(), F.size("r.scattering")).alias("mechanisms"), first["mechanism"].alias("first_mechanism"), F.round(first["fraction"], 6).alias("first_fraction"))


@query("s12_scene_record_sink", "SELECT scene, '1.0' AS schema_version, count(*) AS pixels FROM pixels GROUP BY scene", "pixels")
def s12(spark, d):
    from ..sources.manifests import read_records, write_records

    lw = fx.pixels(spark, d).groupBy("scene").agg(F.count("*").alias("pixels"))
    path = write_records(lw.select("scene", F.struct(F.lit("1.0").alias("schema_version"), "pixels").alias("record")))
    return read_records(spark, path, "struct<schema_version string, pixels long>").select("scene", "record.schema_version", "record.pixels")
