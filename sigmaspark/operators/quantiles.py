"""Exact quantiles of large groups without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins per group in the first pass: the second looks only into those that hold a wanted rank.
BINS = 4096


def quantiles(values: DataFrame, group: str, value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """group, n, lo, hi, p: number, extremes and the quantiles (linear between ranks) of each group's values.

    Counts per bin leave the tasks as partial sums; then the values of the bins that hold a
    wanted rank are counted exactly. Nulls are left out, and groups of nulls alone.
    """
    known = values.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    stats = known.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = known.join(stats, group).withColumn("bin", place.cast("int"))
    # at most ``bins`` rows a group
    upto = Window.partitionBy(group).orderBy("bin")
    counts = binned.groupBy(group, "bin", "n").agg(F.count("*").alias("m")).withColumn("below", F.sum("m").over(upto) - F.col("m"))
    ranks = [(q * (F.col("n") - 1), F.floor(q * (F.col("n") - 1)), F.ceil(q * (F.col("n") - 1))) for q in shares]
    holds = lambda r, start, m: (r >= F.col(start)) & (r < F.col(start) + F.col(m))
    wanted = F.lit(False)
    for _, low, high in ranks:
        wanted = wanted | holds(low, "below", "m") | holds(high, "below", "m")
    inner = binned.join(counts.where(wanted).select(group, "bin", "below"), [group, "bin"]).groupBy(group, "bin", "below", "n", "v").agg(F.count("*").alias("m"))
    inside = Window.partitionBy(group, "bin").orderBy("v")
    each = inner.withColumn("start", F.col("below") + F.sum("m").over(inside) - F.col("m"))
    picked = each.groupBy(group, "n").agg(*[F.max(F.when(holds(r, "start", "m"), F.col("v"))).alias(f"{x}{k}") for k, (_, low, high) in enumerate(ranks) for x, r in (("a", low), ("b", high))])
    p = [F.when(low == high, F.col(f"a{k}")).otherwise((high - at) * F.col(f"a{k}") + (at - low) * F.col(f"b{k}")) for k, (at, low, high) in enumerate(ranks)]
    return stats.join(picked.select(group, F.array(*p).alias("p")), group)
