"""Exact nearest vectors without scoring all: pivots per scope, cells around them, triangle bounds.

Each scope (owner, project) has pivots from a bounded sample of its vectors. Every vector is
stored with its nearest pivot (its cell) and the distance to it. A query looks into the
cells nearest to it until they hold k vectors, which bounds the distance of the k-th; then
only into cells, and there at vectors, that the triangle inequality can't rule out. A large
scope is many cells, and a large cell many units of work, so no key has to fit one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .vectors import dot, l2_normalize

SCOPE = ["owner", "project"]
#: Pivots of a scope, at most; vectors of a unit of work; queries scored at a time.
MOST_PIVOTS, UNIT, BLOCK = 256, 20_000, 256
#: Scopes up to this size are sampled as a whole.
SMALL = 4096
#: Scores are rounded to six places; bounds leave room for that.
SLACK = 1e-6


@dataclass
class Index:
    """Stored vectors (scope, point_id, scene, cell, far, v) and cells (scope, cell, n, nearest, farthest, pivot)."""

    rows: DataFrame
    cells: DataFrame


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def _pivots(own: DataFrame, sizes: DataFrame) -> DataFrame:
    """scope, cell, pivot: about half the root of a scope's size, taken by the hash of their ids."""
    many = F.least(F.lit(MOST_PIVOTS), F.ceil(F.sqrt("n") / 2)).cast("int")
    step = F.when(F.col("n") <= SMALL, 1).otherwise(F.floor(F.col("n") / (4 * many)))
    drawn = own.join(sizes, SCOPE).where(F.pmod(F.xxhash64("point_id"), step) == 0)
    order = Window.partitionBy(*SCOPE).orderBy(F.xxhash64("point_id", F.lit(1)), "point_id")
    return drawn.withColumn("cell", F.row_number().over(order)).where(F.col("cell") <= many).select(*SCOPE, "cell", F.col("v").alias("pivot"))


def build(vectors: DataFrame, path: str | None = None) -> Index:
    """Index of owner, project, point_id, scene, vector, written to ``path``. Vectors of a scope have one length; null ones are left out."""
    spark = vectors.sparkSession
    path = path or f"{shared_path(spark)}/vectors"
    own = vectors.where(F.col("vector").isNotNull()).select(*SCOPE, "point_id", "scene", l2_normalize(F.col("vector")).alias("v"))
    sizes = own.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    _pivots(own, sizes).write.parquet(f"{path}/pivots")
    pivots = spark.read.parquet(f"{path}/pivots")
    units = F.ceil(F.col("n") / UNIT)
    left = own.join(sizes, SCOPE).withColumn("unit", F.pmod(F.xxhash64("point_id", F.lit(2)), units)).drop("n")
    right = pivots.join(sizes, SCOPE).withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), units - 1))).drop("n")

    def nearest(rows: pa.Table, near: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.drop_columns(["unit"]).append_column("cell", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
        v, p, cells = _matrix(rows["v"]), _matrix(near["pivot"]), near["cell"].to_numpy()
        square = (v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T
        best = square.argmin(1)
        far = np.sqrt(((v - p[best]) ** 2).sum(1))
        return rows.drop_columns(["unit"]).append_column("cell", pa.array(cells[best], pa.int32())).append_column("far", pa.array(far))

    kind = dict(own.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in own.columns) + ", cell int, far double"
    key = [*SCOPE, "unit"]
    left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, schema).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    held = rows.groupBy(*SCOPE, "cell").agg(F.count("*").alias("n"), F.min("far").alias("nearest"), F.max("far").alias("farthest"))
    held.join(pivots, [*SCOPE, "cell"]).write.parquet(f"{path}/cells")
    return Index(rows, spark.read.parquet(f"{path}/cells"))


def _scored(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """query, point_id, scene, score: the k best of every unit that a query visits. ``visits`` has query, scope, cell, n, q, d, bound."""
    units = F.ceil(F.col("n") / UNIT)
    sizes = index.cells.select(*SCOPE, "cell", "n")
    left = index.rows.join(sizes, [*SCOPE, "cell"]).withColumn("unit", F.pmod(F.xxhash64("point_id", F.lit(3)), units)).drop("n")
    right = visits.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), units - 1))).drop("n")
    kind = dict(index.rows.dtypes) | dict(visits.dtypes)
    types = {c: kind[c] for c in ("query", "point_id", "scene")}

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, far, v = rows["point_id"], rows["far"].to_numpy(), _matrix(rows["v"])
        rank = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        hits_q, hits_v, hits_s = [], [], []
        q, d, bound = _matrix(asked["q"]), asked["d"].to_numpy(), asked["bound"].to_numpy()
        for at in range(0, asked.num_rows if rows.num_rows else 0, BLOCK):
            for n in range(at, min(at + BLOCK, asked.num_rows)):
                near = np.flatnonzero(np.abs(far - d[n]) <= bound[n])
                if not len(near):
                    continue
                s = np.round(v[near] @ q[n], 6) + 0.0
                if len(near) > k:  # all that tie with the k-th, then by id
                    cut = np.partition(s, -k)[-k]
                    near, s = near[s >= cut], s[s >= cut]
                best = np.lexsort((rank[near], -s))[:k]
                hits_q.append(np.full(len(best), n))
                hits_v.append(near[best])
                hits_s.append(s[best])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits_q, hits_v))
        s = np.concatenate(hits_s) if hits_s else np.zeros(0)
        return pa.table({"query": asked["query"].take(pa.array(a)), "point_id": ids.take(pa.array(b)), "scene": rows["scene"].take(pa.array(b)), "score": pa.array(s)})

    key = [*SCOPE, "cell", "unit"]
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", score double"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, schema)


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest of each query inside its scope (query, point_id, scene, score, rank), and what share was looked at (query, visited, vectors).

    ``queries`` has query (unique), owner, project, vector. Ties go to the smaller point id;
    a scope with fewer vectors gives them all, an empty one none. Results equal those of scoring
    every vector of the scope.
    """
    spark = queries.sparkSession
    folder = f"{shared_path(spark)}/search"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    asked = queries.where(F.col("vector").isNotNull()).select("query", *SCOPE, l2_normalize(F.col("vector")).alias("q"))
    gap = F.zip_with("q", "pivot", lambda a, b: a - b)
    met = asked.join(index.cells, SCOPE).withColumn("d", F.sqrt(dot(gap, gap))).drop("pivot")
    order = Window.partitionBy("query").orderBy("d", "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = written(met.withColumn("first", before < k), "visits")
    seen = written(_scored(index, met.where("first").select("query", *SCOPE, "cell", "n", "q", "d", F.lit(float("inf")).alias("bound")), k), "first")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point_id")
    kth = seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - SLACK))) + SLACK).alias("bound"))
    rest = met.where(~F.col("first")).join(kth, "query").where((F.col("d") - F.col("farthest") <= F.col("bound")) & (F.col("nearest") - F.col("d") <= F.col("bound")))
    more = _scored(index, rest.select("query", *SCOPE, "cell", "n", "q", "d", "bound"), k)
    hits = seen.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    visited = rest.groupBy("query").agg(F.sum("n").alias("later"))
    share = met.groupBy("query").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("early"), F.sum("n").alias("vectors")).join(visited, "query", "left")
    return hits.select("query", "point_id", "scene", "score", "rank"), share.select("query", (F.col("early") + F.coalesce("later", F.lit(0))).alias("visited"), "vectors")
