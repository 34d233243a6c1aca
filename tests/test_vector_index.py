"""Pruned search against scoring all."""

import numpy as np
import pytest

from sigmaspark.operators import vector_index, vectors


def table(spark, seed=1, n=1500, dim=8, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centres[r.integers(12)] + spread * r.normal(size=dim)
        rows.append((k, int(r.integers(10) > 0), 0, int(k % 3), v.tolist()))
    rows += [(n + k, 1, 0, 0, rows[5][4]) for k in range(6)]  # ties
    rows += [(n + 10, 1, 0, 0, [0.0] * dim), (n + 11, 1, 0, 0, None), (n + 12, 7, 7, 1, [1.0] * dim)]
    return spark.createDataFrame(rows, "point_id long, owner int, project int, scene int, vector array<double>")


@pytest.mark.parametrize("unit", [20_000, 40])
def test_equal_to_scoring_all(spark, monkeypatch, unit):
    monkeypatch.setattr(vector_index, "UNIT", unit)
    v = table(spark)
    q = v.where("point_id % 50 = 0 or point_id >= 1500").selectExpr("point_id as query", "owner", "project", "vector")
    q = q.unionAll(spark.createDataFrame([(9999, 3, 3, [1.0] * 8)], q.schema))  # a scope without vectors
    hits, share = vector_index.search(vector_index.build(v), q, 7)
    want = vectors.top_k_batch(v.where("vector is not null"), q.where("vector is not null"), 7)
    key = lambda df: sorted((r.query, r["rank"], r.point_id, r.scene, round(r.score, 6) + 0.0) for r in df.collect())
    assert key(hits) == key(want)
    total = share.groupBy().sum("visited", "vectors").first()
    assert total[0] < 0.5 * total[1]  # clusters are ruled out


def test_empty(spark):
    v = table(spark, n=20)
    q = v.selectExpr("point_id as query", "owner", "project", "vector")
    hits, _ = vector_index.search(vector_index.build(v), q.limit(0), 3)
    assert hits.count() == 0
    hits, _ = vector_index.search(vector_index.build(v.limit(0)), q, 3)
    assert hits.count() == 0
