"""Blocks of vectors and queries against scoring all of them with expressions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigmaspark.operators import vectors


def test_blocks_equal_scoring_all(spark, monkeypatch):
    """Many small blocks; ties, copies, nulls, other lengths, not-a-numbers, fewer rows than asked for."""
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 60)
    monkeypatch.setattr(vectors, "AT_ONCE", 50)
    r = random.Random(5)
    rows = [(n, n % 2, n % 3 if n % 50 else None, n % 4, [round(r.gauss(0, 1), 1) for _ in range(3)]) for n in range(150)]
    rows += [(200 + n, 1, 1, 0, rows[7][4]) for n in range(30)]
    odd = [None, [1.0, None, 2.0], [1.0, 2.0], [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0]]
    rows += [(300 + n + 10 * s, s, s, 0, x) for n, x in enumerate(odd) for s in (0, 9)]
    v = spark.createDataFrame(rows, "point_id long, owner int, project int, scene int, vector array<double>")
    q = v.where("point_id % 7 = 0 or point_id >= 300").selectExpr("point_id as query", "owner", "project", "vector")
    both = v.withColumn("v", vectors.l2_normalize(F.col("vector"))).join(q.withColumn("q", vectors.l2_normalize(F.col("vector"))).drop("vector"), ["owner", "project"])
    scored = both.select("query", "point_id", "scene", F.round(vectors.dot(F.col("v"), F.col("q")), 6).alias("score"))
    for k in (1, 5, 40):
        want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "point_id"))).where(F.col("rank") <= k)
        got = vectors.top_k_batch(v, q, k)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_the_norm_is_summed_once(spark):
    """Where it stood inside the lambda, a long vector took the square of its length."""
    unit = spark.range(1).select(vectors.l2_normalize(F.sequence(F.lit(1), F.lit(30_000))).alias("v"))
    assert abs(unit.select(vectors.dot(F.col("v"), F.col("v"))).first()[0] - 1) < 1e-9
    none = spark.range(1).select(vectors.l2_normalize(F.lit(None).cast("array<float>")).alias("v"))
    assert none.first()[0] is None
