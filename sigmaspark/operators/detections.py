"""Detections: reading, validating, suppressing overlaps, counting."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from . import spatial
from .geo import region_name

logger = logging.getLogger(__name__)

IOU = 0.5
CONTRACT = "detector-output/1"


def validate(raw: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Clipped boxes with a reason where a detection is refused. Reads label, confidence and x_min to y_max as text or numbers."""
    label = F.lower(F.trim(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("unknown"))))
    nums = {c: F.col(c).cast("string").try_cast("double") for c in ("confidence", "x_min", "y_min", "x_max", "y_max")}
    typed = raw.withColumns({f"_{c}": v for c, v in nums.items()}).withColumn("label", label)
    clip = lambda c, n: F.least(F.greatest(F.col(f"_{c}"), F.lit(0.0)), F.col(n).cast("double"))
    clipped = typed.withColumns({c: clip(c, width if c[0] == "x" else height) for c in ("x_min", "y_min", "x_max", "y_max")})
    finite = ~F.greatest(*[F.coalesce((F.isnan(f"_{c}") | (F.abs(f"_{c}") == float("inf"))).cast("int"), F.lit(1)) for c in ("x_min", "y_min", "x_max", "y_max")]).cast("boolean")
    reason = (F.when(F.col("label") == "", "label").when(F.col("_confidence").isNull(), "confidence").when(~F.col("_confidence").between(0.0, 1.0), "confidence").when(~finite, "coordinates")
              .when((F.col("_x_max") <= F.col("_x_min")) | (F.col("_y_max") <= F.col("_y_min")), "area").when((F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min")), "outside"))
    moved = F.lit(False)
    for c in ("x_min", "y_min", "x_max", "y_max"):
        moved = moved | (F.col(c) != F.col(f"_{c}"))
    return clipped.withColumn("reason", reason).withColumn("was_clipped", moved).withColumn("confidence", F.col("_confidence")).drop(*[f"_{c}" for c in nums])


def status(counts: DataFrame) -> Column:
    """Status of a scene's detector from the number of files, readable files and valid detections."""
    return F.when(F.col("files") == 0, "awaiting_detector_output").when(F.col("readable") == 0, "invalid_detector_output").when(F.col("valid") == 0, "completed_no_valid_detections").otherwise("completed")


def detector_scan(files: DataFrame, key: str = "scene", json: str = "value") -> DataFrame:
    """Detections of each file: a JSON list, or an object with a list of them. Unreadable files give one row without a detection."""
    item = "struct<id:string,label:string,confidence:string,bbox_xyxy:array<double>>"
    both = files.withColumn("as_list", F.from_json(json, f"array<{item}>")).withColumn("as_object", F.from_json(json, f"struct<detections:array<{item}>>"))
    items = F.when(F.col(json).rlike(r"^\s*\["), F.col("as_list")).otherwise(F.col("as_object.detections"))
    return both.select(key, items.isNotNull().alias("readable"), F.explode_outer(items).alias("d"))


def sidecar_reason(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Why a detector sidecar is refused, or null: version tag, name and version, list of detections, checksum of a known source."""
    known = files.join(checksums.select("checksum").distinct().withColumn("known", F.lit(True)), "checksum", "left")
    reason = (F.when(F.coalesce(F.col("contract"), F.lit("")) != CONTRACT, "not_a_sidecar").when(F.trim(F.coalesce("name", F.lit(""))) == "", "name").when(F.trim(F.coalesce("version", F.lit(""))) == "", "version")
              .when(F.col("known").isNull(), "checksum").when(F.col("detections").isNull(), "detections"))
    return known.withColumn("reason", reason)


def iou(a: str, b: str) -> Column:
    c = lambda p, n: F.col(f"{p}_{n}")
    w = F.greatest(F.least(c(a, "x_max"), c(b, "x_max")) - F.greatest(c(a, "x_min"), c(b, "x_min")), F.lit(0.0))
    h = F.greatest(F.least(c(a, "y_max"), c(b, "y_max")) - F.greatest(c(a, "y_min"), c(b, "y_min")), F.lit(0.0))
    area = lambda p: (c(p, "x_max") - c(p, "x_min")) * (c(p, "y_max") - c(p, "y_min"))
    return w * h / (area(a) + area(b) - w * h)


def iou_pairs(boxes: DataFrame, threshold: float = IOU, cell: float = 64.0, scene: str = "scene", crowd: int = spatial.CROWD) -> DataFrame:
    """better, worse, iou: overlapping pairs of one scene and label, the better by confidence then id.

    Boxes meet in the cells that they touch, smaller ones where they crowd; the pair is made
    in the cell of its overlap's corner alone. Reads id, label, confidence and the four coordinates.
    """
    columns = ("id", "confidence", "x_min", "y_min", "x_max", "y_max")
    side = lambda p: boxes.select(F.col(scene), "label", *[F.col(c).alias(f"{p}_{c}") for c in columns])
    box = lambda p: tuple(f"{p}_{c}" for c in columns[2:])
    met = spatial.overlapping(side("a"), side("b"), [scene, "label"], box("a"), box("b"), cell, crowd)
    better = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_id") < F.col("b_id")))
    found = met.where(better).withColumn("iou", iou("a", "b")).where(F.col("iou") > threshold)
    return found.select(scene, "label", F.col("a_id").alias("better"), F.col("b_id").alias("worse"), "iou", F.col("a_confidence").alias("confidence"))


#: Groups (scene, label) with up to so many overlapping pairs are settled by one task in one pass.
ONE_PASS_PAIRS = 50_000


def _settle_group(pairs: pd.DataFrame) -> pd.DataFrame:
    """Lost boxes of one scene and label: the best kept box of those that overlap it better."""
    scene, label = pairs.columns[0], "label"
    rank = dict(zip(pairs["better"], pairs["confidence"], strict=True))
    over: dict[int, list[int]] = {}
    for a, b in zip(pairs["better"].tolist(), pairs["worse"].tolist(), strict=True):
        over.setdefault(b, []).append(a)
    lost: dict[int, int] = {}
    # a better box that nothing overlaps is kept; boxes that are never better decide nothing and come last
    for b in sorted(over, key=lambda x: (x not in rank, -rank.get(x, 0.0), x)):
        kept = [a for a in over[b] if a not in lost]
        if kept:
            lost[b] = min(kept, key=lambda a: (-rank[a], a))
    return pd.DataFrame({scene: pairs[scene].iloc[0], label: pairs[label].iloc[0], "id": list(lost), "winner": list(lost.values())}, columns=[scene, label, "id", "winner"])


def _settle_in_rounds(pairs: DataFrame, scene: str, most: int = 10_000) -> DataFrame:
    """Lost boxes of groups of any size: in each round, boxes that no open box overlaps better are kept, and end those that they overlap."""
    spark, folder = pairs.sparkSession, shared_path(pairs.sparkSession)
    key = [scene, "label"]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    open_, lost = pairs.select(*key, "better", "worse"), None
    for n in range(most):
        is_worse = open_.select(*key, F.col("worse").alias("better")).distinct()
        kept = open_.join(is_worse, [*key, "better"], "left_anti")
        ended = written(kept.select(*key, F.col("worse").alias("id")).distinct(), f"lost{n}")
        lost = ended if lost is None else lost.unionByName(ended)
        # pairs of kept boxes are settled, as all that they overlap has ended
        open_ = written(open_.join(ended.withColumnRenamed("id", "worse"), [*key, "worse"], "left_anti").join(ended.withColumnRenamed("id", "better"), [*key, "better"], "left_anti"), f"open{n}")
        left = open_.count()
        logger.info("suppression round %d: %d pairs left", n + 1, left)
        if not left:
            break
    alive = pairs.join(lost.withColumnRenamed("id", "better"), [*key, "better"], "left_anti")
    best = alive.groupBy(*key, F.col("worse").alias("id")).agg(F.max_by("better", F.struct("confidence", -F.col("better"))).alias("winner"))
    return best.join(lost, [*key, "id"], "left_semi")


def suppress(boxes: DataFrame, threshold: float = IOU, scene: str = "scene", one_pass: int = ONE_PASS_PAIRS) -> DataFrame:
    """Greedy suppression per scene and label: scene, label, id, winner (null for kept boxes).

    Ids are unique within a scene and label. A box's fate hangs only on better boxes that
    overlap it: groups with few pairs are settled in confidence order by one task each, the
    others in rounds of joins over all of them at once.
    """
    spark, key = boxes.sparkSession, [scene, "label"]
    path = f"{shared_path(spark)}/pairs"
    iou_pairs(boxes, threshold, scene=scene).drop("iou").write.parquet(path)
    pairs = spark.read.parquet(path)
    large = pairs.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > one_pass).select(*key)
    kind = dict(pairs.dtypes)
    few = pairs.join(large, key, "left_anti").groupBy(*key).applyInPandas(_settle_group, f"`{scene}` {kind[scene]}, label string, id {kind['worse']}, winner {kind['better']}")
    lost = few if large.isEmpty() else few.unionByName(_settle_in_rounds(pairs.join(large, key, "left_semi"), scene))
    return boxes.select(*key, "id").join(lost.hint("merge"), [*key, "id"], "left")


def numbered(kept: DataFrame, scene: str = "scene") -> DataFrame:
    """Names object-0001 and on, by confidence, within each scene."""
    order = Window.partitionBy(scene).orderBy(F.desc("confidence"), "id")
    return kept.withColumn("object_id", F.format_string("object-%04d", F.row_number().over(order)))


def spatial_groups(found: DataFrame, scene: str = "scene") -> DataFrame:
    region = region_name((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, F.col("width"), F.col("height"))
    return found.withColumn("region", region).groupBy(scene, "label", "region").agg(F.count("*").alias("n"))


def label_counts(found: DataFrame, scene: str = "scene") -> DataFrame:
    each = found.groupBy(scene, "label").agg(F.count("*").alias("n"))
    return each.groupBy(scene).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s (%d)", "label", "n"))), ", ").alias("labels"))


def answer_stats(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Per question (question, scene, label): matches, confidence range, regions."""
    region = region_name((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, F.col("width"), F.col("height"))
    met = asked.join(found.withColumn("region", region), ["scene", "label"], "left")
    return met.groupBy("question", "scene", "label").agg(F.count("confidence").alias("matches"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.array_join(F.array_sort(F.collect_set("region")), ", ").alias("regions"))


def safe_facts(facts: DataFrame, scene: str = "scene", most: int = 50) -> DataFrame:
    """At most ``most`` facts a scene, in order of their position: label and id cut short, confidence clamped; nameless ones dropped."""
    order = Window.partitionBy(scene).orderBy("position")
    named = facts.where(F.trim(F.coalesce("label", F.lit(""))) != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return named.select(scene, "position", F.substring("label", 1, 160).alias("label"), F.substring(F.col("id").cast("string"), 1, 100).alias("id"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
