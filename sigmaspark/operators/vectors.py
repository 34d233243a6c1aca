"""Patch vectors: scoped search, writes and deletes, score rules."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
SCORE_FLOOR, STEEP, WEAK = 0.20, 0.05, 0.16
SCOPE = ["owner", "project", "scene"]
#: Numbers of a block of vectors or queries, and of what a task holds beside them at a time.
BLOCK_NUMBERS, AT_ONCE = 500_000, 4_000_000
#: Rounded scores of rows so far below the k-th best can't reach it.
MARGIN = 3e-6


def scoped(vectors: DataFrame, owner: Column | None, project: Column | None, scene: Column | None = None, scenes: list | None = None) -> DataFrame:
    """Rows of one owner and project, and of a scene or a list of scenes; an incomplete scope is an error, an empty list has no rows."""
    if owner is None or project is None:
        raise ValueError("owner and project belong together")
    if scene is not None and scenes is not None:
        raise ValueError("either a scene or a list of scenes")
    rows = vectors.where((F.col("owner") == owner) & (F.col("project") == project))
    if scene is not None:
        rows = rows.where(F.col("scene") == scene)
    return rows.where(F.col("scene").isin(scenes)) if scenes is not None else rows


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # inside the lambda of the elements the norm would be summed for each of them
    return F.flatten(F.transform(F.array(F.greatest(norm, F.lit(1e-12))), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest rows by cosine, with rank; ties by point id."""
    unit = l2_normalize(F.array(*[F.lit(float(x)) for x in query]))
    best = vectors.select("point_id", "scene", F.round(dot(l2_normalize(F.col("vector")), unit), 6).alias("score")).orderBy(F.desc("score"), "point_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")))


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` times 10^6, half up as Spark rounds: what lies next to a half is decided by its decimal digits. NaN is the largest."""
    scaled = np.abs(x) * 1e6
    out = np.floor(scaled + 0.5)
    for n in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[n] = float(Decimal(repr(abs(float(x[n])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), np.inf, np.sign(x) * out)


def _matrices(rows: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each width and their unit vectors as a matrix (summed in order, as ``l2_normalize`` does); without those of width -1, which have no score."""
    widths = rows.column("width").to_numpy()
    held = rows.column(column).combine_chunks()
    at = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths) if w >= 0}
    out = {}
    for w, n in at.items():
        x = held.take(pa.array(n)).flatten().to_numpy(zero_copy_only=False).reshape(len(n), w)
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, [-1]]) if w else np.ones((len(n), 1))
        out[w] = n, x / np.maximum(norm, 1e-12)
    return out


def _block_hits(v: pa.Table, q: pa.Table, k: int) -> pa.Table:
    """query, point_id, scene, score of the k best rows of the block for each query.

    A matrix product finds what can be among them; their scores are then summed as Spark's
    expression sums them, and the rounded score and the id decide.
    """
    rank = pc.rank(v.column("point_id").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64)
    stored = _matrices(v, "v")
    asked, found, scores = [], [], []
    scored = np.zeros(q.num_rows, np.int64)
    for width, (q_at, qs) in _matrices(q, "q").items():
        if width not in stored:
            continue
        v_at, vs = stored[width]
        scored[q_at] = len(v_at)
        step = max(1, AT_ONCE // len(v_at))
        for first in range(0, len(q_at), step):
            some = qs[first : first + step]
            near = some @ vs.T
            near[np.isnan(near)] = np.inf
            if len(v_at) > k:
                near = near >= np.partition(near, len(v_at) - k, axis=1)[:, [len(v_at) - k]] - MARGIN
            else:
                near = np.ones(near.shape, bool)
            a, b = np.nonzero(near)
            exact = np.zeros(len(a))
            part = max(1, AT_ONCE // max(1, width))
            for x in range(0, len(a) if width else 0, part):
                exact[x : x + part] = np.cumsum(some[a[x : x + part]] * vs[b[x : x + part]], axis=1)[:, -1]
            order = np.lexsort((rank[v_at[b]], -_rounded(exact), a))
            a, b, exact = a[order], b[order], exact[order]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            asked.append(q_at[first + a[top]])
            found.append(v_at[b[top]])
            scores.append(exact[top])
    short = np.flatnonzero(scored < k)
    for n in short:  # rows without a score come last
        width = q.column("width")[int(n)].as_py()
        rest = np.setdiff1d(np.arange(v.num_rows), stored[width][0] if width in stored else [])
        rest = rest[np.argsort(rank[rest])][:k]
        asked.append(np.full(len(rest), n))
        found.append(rest)
        scores.append(np.full(len(rest), np.inf))
    asked, found, scores = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((asked, np.int64), (found, np.int64), (scores, np.float64)))
    hits = v.select(["point_id", "scene"]).take(pa.array(found))
    return pa.table({"query": q.column("query").take(pa.array(asked)), "point_id": hits.column("point_id"), "scene": hits.column("scene"), "score": pa.array(scores, mask=np.isposinf(scores))})


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every query inside its scope (owner, project).

    Both are dealt into blocks of a bounded size inside their scope, and a block of queries
    meets a block of vectors in one task, as matrices; it leaves k rows a query.
    """
    scope = ["owner", "project"]
    # a row with a null number has no score
    width = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.size(c)).otherwise(-1).alias("width")
    numbers = F.sum(F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(k)))
    blocks = lambda df, name: df.groupBy(*scope).agg(F.ceil(numbers / BLOCK_NUMBERS).cast("int").alias(name))
    dealt = blocks(vectors, "v_blocks").join(blocks(queries, "q_blocks"), scope)
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    plain = F.col("vector").cast("array<double>")
    v = vectors.select(*scope, "point_id", "scene", plain.alias("v")).join(dealt, scope)
    v = v.select(*scope, own("v_blocks", "point_id", "v").alias("v_block"), every("q_blocks").alias("q_block"), "point_id", "scene", "v", width("v"))
    q = queries.select(*scope, "query", plain.alias("q")).join(dealt, scope)
    # queries may come from the same table: their keys get names of their own
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in scope], every("v_blocks").alias("v_block"), own("q_blocks", "query", "q").alias("q_block"), "query", "q", width("q"))
    key, kind = [*scope, "v_block", "q_block"], dict(v.dtypes) | dict(q.dtypes)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_hits(left, right, k)

    met = v.groupBy(*key).cogroup(q.groupBy(*[f"q_{c}" for c in scope], *key[2:])).applyInArrow(meet, f"query {kind['query']}, point_id {kind['point_id']}, scene {kind['scene']}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point_id")
    scored = met.withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_spread(hits: DataFrame) -> DataFrame:
    """Per query: fail_floor without a good top score, steep if the tenth (or last) lies far below the top, else flat."""
    by = hits.groupBy("query").agg(F.max("score").alias("top"), F.min(F.when(F.col("rank") <= 10, F.col("score"))).alias("low"))
    return by.select("query", F.when(F.col("top").isNull() | (F.col("top") < SCORE_FLOOR), "fail_floor").when(F.round(F.col("top") - F.col("low"), 6) > STEEP, "steep").otherwise("flat").alias("spread"))


def retrieval_state(hits: DataFrame, queries: DataFrame) -> DataFrame:
    top = queries.select("query").join(hits.groupBy("query").agg(F.max("score").alias("top")), "query", "left")
    return top.select("query", F.when(F.col("top").isNull(), "empty").when(F.col("top") < WEAK, "weak").otherwise("results").alias("state"))


def first_hits(hits: DataFrame) -> DataFrame:
    """One row per query and valid point id: the one of the smallest rank."""
    order = Window.partitionBy("query", "point_id").orderBy("rank")
    return hits.where(F.col("point_id").isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def payload_reason() -> Column:
    """Why a vector can't be written, or null: complete scope, bounds in order."""
    missing = F.lit(False)
    for c in SCOPE:
        missing = missing | F.col(c).isNull()
    return F.when(missing, "scope").when(F.col("vector").isNull() | (F.size("vector") == 0), "vector").when((F.col("row_start") < 0) | (F.col("row_end") <= F.col("row_start")), "bounds")


def upsert(stored: DataFrame, fresh: DataFrame, key: str | list[str]) -> DataFrame:
    """All rows by key (a column or several); a fresh row replaces the stored one. Fresh rows have a unique key."""
    own = [key] if isinstance(key, str) else key
    return stored.join(fresh.select(*own), own, "left_anti").unionByName(fresh)


def delete_scoped(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows outside every request; a request without its full scope deletes nothing."""
    return stored.join(requests.dropna(subset=SCOPE).select(*SCOPE).distinct(), SCOPE, "left_anti")


def counts(stored: DataFrame, scopes: DataFrame) -> DataFrame:
    """Vectors of every scope, zero where it has none."""
    n = stored.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    return scopes.select(*SCOPE).distinct().join(n, SCOPE, "left").select(*SCOPE, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def cards(hits: DataFrame, patches: DataFrame, previews: DataFrame, scenes: DataFrame) -> DataFrame:
    """Hits with their ready patches, previews if any, and scenes; hits that join none are gone, ranks stay."""
    ready = patches.where("status = 'ready'")
    return hits.join(ready.drop("scene"), "point_id").join(previews, "point_id", "left").join(scenes, "scene")
