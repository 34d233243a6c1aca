"""Queries over patch vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vector_index, vectors
from . import fixtures as fx
from .registry import VIEWS, query


def _vectors(spark, d) -> DataFrame:
    return fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), (F.col("label") % 2).alias("owner"), (F.col("label") % 3).alias("project"), F.col("label").alias("scene"), F.col("embedding").alias("vector"))


def _queries(spark, d) -> DataFrame:
    return _vectors(spark, d).where("point_id % 20 = 0").select(F.col("point_id").alias("query"), "owner", "project", "vector")


VIEWS["vecs"] = """SELECT vec_id AS point_id, label % 2 AS owner, label % 3 AS project, label AS scene, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings"""
VIEWS["vhits"] = """SELECT query, point_id, scene, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, point_id) AS rank FROM (
    SELECT q.point_id AS query, v.point_id, v.scene, round(list_dot_product(v.v, q.v), 6) AS score FROM vecs v JOIN vecs q ON q.owner = v.owner AND q.project = v.project AND q.point_id % 20 = 0)"""
VIEWS["vtop"] = "SELECT * FROM vhits WHERE rank <= 10"


def _hits(spark, d, k: int = 10) -> DataFrame:
    return vectors.top_k_batch(_vectors(spark, d), _queries(spark, d), k)


@query("t01_vector_topk", "SELECT v.point_id, v.scene, round(list_dot_product(v.v, q.v), 6) AS score, row_number() OVER (ORDER BY round(list_dot_product(v.v, q.v), 6) DESC, v.point_id)::INT AS rank FROM vecs v, (SELECT * FROM vecs WHERE point_id = (SELECT min(point_id) FROM vecs)) q WHERE v.owner = 0 AND v.project = 1 ORDER BY score DESC, point_id LIMIT 10", "vecs")
def t01(spark, d):
    v = _vectors(spark, d)
    first = v.orderBy("point_id").select("vector").first()
    return vectors.top_k(vectors.scoped(v, F.lit(0), F.lit(1)), first[0] if first else [0.0], 10)


@query("t02_vector_topk_pruned", "SELECT query, point_id, score, rank::INT AS rank FROM vtop", "vtop")
def t02_pruned(spark, d):
    hits, _ = vector_index.search(vector_index.build(_vectors(spark, d)), _queries(spark, d), 10)
    return hits.select("query", "point_id", "score", "rank")


@query("t02_vector_topk_batch", "SELECT query, point_id, score, rank::INT AS rank FROM vtop", "vtop")
def t02(spark, d):
    return _hits(spark, d).select("query", "point_id", "score", "rank")


@query("m04_l2_normalize", "SELECT point_id, len(v)::INT AS n, round(list_dot_product(v, v), 6) AS length FROM vecs", "vecs")
def m04(spark, d):
    v = _vectors(spark, d).select("point_id", vectors.l2_normalize(F.col("vector")).alias("v"))
    return v.select("point_id", F.size("v").alias("n"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length"))


@query("a17_vector_counts", "SELECT owner, project::BIGINT AS project, scene, count(point_id) AS n FROM (SELECT owner, project, scene, point_id FROM vecs UNION ALL SELECT n_nationkey + 100, 0, n_nationkey, NULL FROM nation) GROUP BY ALL", "vecs")
def a17(spark, d):
    v = _vectors(spark, d)
    none = fx.read(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("owner"), F.lit(0).cast("long").alias("project"), F.col("n_nationkey").alias("scene"))
    return vectors.counts(v, v.select(*vectors.SCOPE).unionAll(none))


@query("f08_tenant_scope", "SELECT point_id, scene FROM vecs WHERE owner = 1 AND project = 2", "vecs")
def f08(spark, d):
    return vectors.scoped(_vectors(spark, d), F.lit(1), F.lit(2)).select("point_id", "scene")


@query("s20_vector_scoped_write", "SELECT point_id, scene, CASE WHEN point_id % 3 = 0 THEN 'new' ELSE 'old' END AS written FROM vecs UNION ALL SELECT point_id + 1000000, scene, 'new' FROM vecs WHERE point_id % 3 = 0 AND point_id % 2 = 0", "vecs")
def s20(spark, d):
    # added points are others than the stored ones, also where a stored one has their number
    v = _vectors(spark, d).select("*", F.lit(False).alias("added"), F.lit("old").alias("written"), F.lit(0).alias("row_start"), F.lit(224).alias("row_end"))
    fresh = v.where("point_id % 3 = 0").withColumn("written", F.lit("new"))
    added = fresh.where("point_id % 2 = 0").withColumn("point_id", F.col("point_id") + 1000000).withColumn("added", F.lit(True))
    broken = fresh.withColumn("point_id", F.col("point_id") + 2000000).withColumn("row_end", F.lit(0))
    valid = fresh.unionByName(added).unionByName(broken).where(vectors.payload_reason().isNull())
    return vectors.upsert(v, valid, ["point_id", "added"]).select("point_id", "scene", "written")


@query("s21_vector_scoped_delete", "SELECT point_id FROM vecs WHERE scene NOT IN (1, 4)", "vecs")
def s21(spark, d):
    v = _vectors(spark, d)
    wanted = v.where("scene in (1, 4)").select(*vectors.SCOPE).unionAll(v.where("scene = 2").select("owner", F.lit(None).cast("long").alias("project"), "scene"))
    return vectors.delete_scoped(v, wanted).select("point_id")


@query("w11_score_spread", "SELECT query, CASE WHEN max(score) < 0.2 THEN 'fail_floor' WHEN round(max(score) - min(score), 6) > 0.05 THEN 'steep' ELSE 'flat' END AS spread FROM vtop GROUP BY query", "vtop")
def w11(spark, d):
    return vectors.score_spread(_hits(spark, d))


@query("w15_retrieval_state", "SELECT point_id AS query, CASE WHEN top IS NULL THEN 'empty' WHEN top < 0.16 THEN 'weak' ELSE 'results' END AS state FROM vecs LEFT JOIN (SELECT query, max(score) AS top FROM vtop GROUP BY query) ON query = point_id WHERE point_id % 20 = 0", "vecs vtop")
def w15(spark, d):
    return vectors.retrieval_state(_hits(spark, d), _queries(spark, d))


@query("w12_hit_dedupe", "SELECT query, point_id, min(rank)::INT AS rank FROM vtop GROUP BY ALL", "vtop")
def w12(spark, d):
    h = _hits(spark, d)
    twice = h.unionByName(h.withColumn("rank", F.col("rank") + 10)).unionByName(h.withColumn("point_id", F.lit(None).cast("long")))
    return vectors.first_hits(twice).select("query", "point_id", "rank")


@query("j01_hits_to_cards", "SELECT query, point_id, rank::INT AS rank, CASE WHEN point_id % 4 = 0 THEN 'preview-' || point_id END AS preview, 'name-' || scene AS scene_name FROM vtop WHERE point_id % 5 <> 0", "vtop")
def j01(spark, d):
    v = _vectors(spark, d)
    patches = v.select("point_id", F.when(F.col("point_id") % 5 == 0, "pending").otherwise("ready").alias("status"))
    previews = v.where("point_id % 4 = 0").select("point_id", F.concat(F.lit("preview-"), "point_id").alias("preview"))
    scenes = v.select("scene").distinct().select("scene", F.concat(F.lit("name-"), "scene").alias("scene_name"))
    return vectors.cards(_hits(spark, d), patches, previews, scenes).select("query", "point_id", "rank", "preview", "scene_name")


@query("j02_scope_recheck", "SELECT query, point_id, rank::INT AS rank FROM vtop WHERE scene <> 3", "vtop")
def j02(spark, d):
    allowed = _vectors(spark, d).where("scene <> 3").select("scene").distinct()
    return _hits(spark, d).join(allowed, "scene", "left_semi").select("query", "point_id", "rank")


@query("s11_embedding_manifest", "SELECT point_id, len(v)::INT AS n FROM vecs", "vecs")
def s11(spark, d):
    from ..sources.manifests import read_manifest, write_manifest

    path = write_manifest(_vectors(spark, d).select("point_id", "vector"), dimension=None)
    return read_manifest(spark, path).select("point_id", F.size("vector").alias("n"))


VIEWS["means"] = "SELECT vec_id AS point_id, list_transform(range(0, 8), lambda k: list_avg(embedding[8 * k + 1 : 8 * k + 8]::DOUBLE[]) + 0.01) AS m FROM embeddings"


@query("m01_embed_patches", "SELECT point_id, 1.0::DOUBLE AS length, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[8] / sqrt(list_dot_product(m, m)), 6) AS last FROM means", "means")
def m01(spark, d):
    from ..operators.inference import encode

    def means(images: np.ndarray) -> np.ndarray:  # stands for a network
        return images.reshape(len(images), 8, -1).astype(np.float64).mean(axis=2) + 0.01

    out = encode(_vectors(spark, d), lambda: means, "point_id", "vector", dimension=8)
    e = F.col("embedding")
    return out.select("point_id", F.round(vectors.dot(e, e), 6).alias("length"), F.round(e[0], 6).alias("first"), F.round(e[7], 6).alias("last"))


VIEWS["asked"] = """SELECT conv_id, turn, length(n) + 1.0::DOUBLE AS a, length(n) - length(replace(n, ' ', '')) + 1.0::DOUBLE AS b FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g')) AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""


@query("m02_embed_queries", "SELECT conv_id, turn, 1.0::DOUBLE AS length, round(a / sqrt(a * a + b * b), 6) AS first, round(b / sqrt(a * a + b * b), 6) AS last FROM asked", "asked")
def m02(spark, d):
    from ..operators.inference import encode_texts

    def lengths(texts: list[str]) -> np.ndarray:  # stands for a network
        return np.array([[len(t) + 1.0, t.count(" ") + 1.0] for t in texts])

    asked = fx.read(spark, d, "conversations").where("role = 'user' and text is not null")
    out = encode_texts(asked, lambda: lengths, "text", dimension=2)
    e = F.col("embedding")
    return out.select("conv_id", "turn", F.round(vectors.dot(e, e), 6).alias("length"), F.round(e[0], 6).alias("first"), F.round(e[1], 6).alias("last"))


@query("m03_score_windows", "SELECT vec_id AS point_id, 4 AS classes, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS first, round(1 / (1 + exp(-embedding[4]::DOUBLE)), 6) AS last FROM embeddings")
def m03(spark, d):
    from ..operators.inference import score_windows

    def logits(x: np.ndarray) -> np.ndarray:  # stands for a network
        return x[:, :4]

    return score_windows(_vectors(spark, d), lambda: logits, "point_id", "vector").select("point_id", F.size("scores").alias("classes"), F.round(F.col("scores")[0], 6).alias("first"), F.round(F.col("scores")[3], 6).alias("last"))
