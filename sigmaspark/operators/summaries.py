"""Quantiles, Otsu's cut and the share below it from two scans of a scene's values.

The first scan counts values in narrow bins of a fixed width, a partial aggregate that tasks
merge. It tells between which values the wanted quantiles lie, and so, but for narrow strips
about the edges, to which of Otsu's bins a value belongs. The second scan counts the values
in those strips exactly. All else is done on counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path

#: Narrow bins per unit (dB).
FINE = 4096
#: One row a scene is broadcast up to so many scenes.
BROADCAST_SCENES = 500_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several plans read, and read it back."""
    path = f"{shared_path(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_SCENES) -> DataFrame:
    """A written frame, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def between_classes(counts: DataFrame, scene: str, bins: int) -> DataFrame:
    """Per scene the bin that parts ``counts`` (scene, lo, hi, bin, n) best, first of equals, and its centre."""
    width = (F.col("hi") - F.col("lo")) / bins
    # a scene has at most ``bins`` rows here
    upto, whole = Window.partitionBy(scene).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(scene)
    run = counts.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width).withColumn("share", F.col("n") / F.sum("n").over(whole))
    run = run.withColumn("omega", F.sum("share").over(upto)).withColumn("mu", F.sum(F.col("share") * F.col("centre")).over(upto)).withColumn("total", F.sum(F.col("share") * F.col("centre")).over(whole))
    parted = F.when(F.col("omega") < 1 - 1e-12, F.pow(F.col("total") * F.col("omega") - F.col("mu"), F.lit(2.0)) / (F.col("omega") * (1 - F.col("omega"))))
    best = run.withColumn("between", F.round(parted, 9)).groupBy(scene).agg(F.max_by(F.struct("bin", "centre"), F.struct("between", -F.col("bin"))).alias("b"))
    return best.select(scene, F.col("b.bin").alias("bin"), F.col("b.centre").alias("otsu"))


def _bin(x: Column, bins: int) -> Column:
    return F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")


def _above(x: Column, at: Column, bins: int) -> Column:
    return x > F.col("lo") + (at + 0.5) * ((F.col("hi") - F.col("lo")) / bins)


def clipped_cut(values: DataFrame, scene: str, value: str, low: float, high: float, bins: int = 256, least: int = 1, contrast: float = 0.0, fine: int = FINE) -> DataFrame:
    """scene, n, lo, hi, otsu, below: quantiles (linear between ranks), Otsu's cut of the values clipped to them, share of values at or below it.

    otsu and below are null for scenes of fewer than ``least`` values or whose quantiles are less
    than ``contrast`` apart, or equal. Null and NaN values are left out. The counts of a scene have at
    most ``fine`` rows a unit of its range.
    """
    x = F.col(value).cast("double")
    own = values.where(x.isNotNull() & ~F.isnan(x)).select(scene, x.alias("x"))
    counted = written(own.groupBy(scene, F.floor(F.col("x") * fine).alias("fine")).agg(F.count("*").alias("m"), F.min("x").alias("a"), F.max("x").alias("b")), "counts")
    upto = Window.partitionBy(scene).orderBy("fine").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("before", F.sum("m").over(upto) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(scene)))
    ranks = {f"{side}{end}": f(q * (F.col("n") - 1)) for side, q in (("lo", low), ("hi", high)) for end, f in (("1", F.floor), ("2", F.ceil))}
    holds = {k: (r >= F.col("before")) & (r < F.col("before") + F.col("m")) for k, r in ranks.items()}
    # the values of these ranks lie between the extremes of their narrow bins
    stats = placed.groupBy(scene, "n").agg(*[F.max(F.when(h, F.col("a" if k[2] == "1" else "b"))).alias(k) for k, h in holds.items()], *[F.max(F.when(h, F.struct("fine", "before"))).alias(f"{k}_bin") for k, h in holds.items()])
    stats = few(written(stats, "stats"))

    # where an edge of a bin or its middle may fall, over all that the quantiles may still be
    step = lambda x, lo, hi: F.floor(2 * bins * (x - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-300)))
    margin = 1.0 / (fine * 1000)
    first, last = step(F.col("fine") / fine - margin, "lo2", "hi2"), step((F.col("fine") + 1) / fine + margin, "lo1", "hi1")
    wanted = F.lit(False)
    for k in ranks:
        wanted = wanted | (F.col("fine") == F.col(f"{k}_bin.fine"))
    inside = ((F.col("fine") + 1) / fine >= F.col("lo1") - margin) & (F.col("fine") / fine <= F.col("hi2") + margin)
    strip = wanted | (inside & ((first != last) | (F.col("hi1") <= F.col("lo2"))))
    exact = written(own.withColumn("fine", F.floor(F.col("x") * fine)).join(stats, scene).where(strip).groupBy(scene, "fine", "x").agg(F.count("*").alias("m")), "strips")

    within = Window.partitionBy(scene, "fine").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    each = exact.join(stats, scene).withColumn("run", F.sum("m").over(within))
    start = {k: F.col(f"{k}_bin.before") + F.col("run") - F.col("m") for k in ranks}
    picked = each.groupBy(scene, "n").agg(*[F.max(F.when((F.col("fine") == F.col(f"{k}_bin.fine")) & (r >= start[k]) & (r < start[k] + F.col("m")), F.col("x"))).alias(k) for k, r in ranks.items()])
    between = lambda side, q: F.when(ranks[f"{side}1"] == ranks[f"{side}2"], F.col(f"{side}1")).otherwise((ranks[f"{side}2"] - q * (F.col("n") - 1)) * F.col(f"{side}1") + (q * (F.col("n") - 1) - ranks[f"{side}1"]) * F.col(f"{side}2"))
    ends = few(written(picked.select(scene, "n", between("lo", low).alias("lo"), between("hi", high).alias("hi")), "ends"))

    usable = (F.col("n") >= least) & (F.col("hi") - F.col("lo") >= contrast) & (F.col("hi") > F.col("lo"))
    whole = counted.join(stats, scene).where(~strip).select(scene, F.col("a").alias("x"), "m")
    both = whole.unionByName(exact.select(scene, "x", "m")).join(ends, scene).where(usable).withColumn("x", F.least(F.greatest("x", "lo"), F.col("hi")))
    binned = both.withColumn("bin", _bin(F.col("x"), bins))
    halves = written(binned.groupBy(scene, "lo", "hi", "bin").agg(F.sum("m").alias("n"), F.sum(F.when(_above(F.col("x"), F.col("bin"), bins), 0).otherwise(F.col("m"))).alias("lower")), "halves")
    cut = between_classes(halves.select(scene, "lo", "hi", "bin", "n"), scene, bins).withColumnRenamed("bin", "at")
    below = halves.join(cut, scene).groupBy(scene, "otsu").agg((F.sum(F.when(F.col("bin") < F.col("at"), F.col("n")).when(F.col("bin") == F.col("at"), F.col("lower")).otherwise(0)) / F.sum("n")).alias("below"))
    return ends.join(below, scene, "left").select(scene, "n", "lo", "hi", "otsu", "below")
