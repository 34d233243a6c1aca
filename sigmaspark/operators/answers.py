"""Answers put together from tables: text columns with their limits stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def detector_answer(target: Column, status: Column, matches: Column, low: Column, high: Column, regions: Column, counting: Column, locating: Column) -> Column:
    """What the detector's record says of a class; an unrun detector is not an empty result, an empty one is no proof."""
    span = F.when(low.isNotNull(), F.concat(F.lit(" Confidence "), percent(low), F.lit(" to "), percent(high), F.lit("."))).otherwise("")
    where = F.when(locating & (regions != ""), F.concat(F.lit(" Regions: "), regions, F.lit("."))).otherwise("")
    n = F.concat(matches.cast("string"), F.lit(" "), target, F.when(matches == 1, " candidate").otherwise(" candidates"))
    found = F.concat(F.when(counting, F.lit("Detector record: ")).otherwise(F.lit("Yes, detector record: ")), n, F.lit("."), span, where)
    return (F.when(target.isNull(), None).when(matches > 0, found).when(status.isin("awaiting_detector_output", "unknown"), F.concat(F.lit("Undecided: no detector has run for "), target, F.lit(".")))
            .otherwise(F.concat(F.lit("No "), target, F.lit(" recorded; that doesn't prove absence."))))


def scattering_sentence(mechanisms: Column) -> Column:
    """Mechanisms (struct mechanism, fraction) by falling share; null without any."""
    order = F.array_sort(mechanisms, lambda a, b: F.when(a["fraction"] > b["fraction"], -1).when(a["fraction"] < b["fraction"], 1).otherwise(F.when(a["mechanism"] < b["mechanism"], -1).otherwise(1)))
    named = F.array_join(F.transform(order, lambda m: F.concat(percent(m["fraction"]), F.lit(" "), m["mechanism"])), "; ")
    return F.when(F.size(mechanisms) > 0, F.concat(F.lit("Measured scattering: "), named, F.lit(".")))


def land_water_sentence(label: Column) -> Column:
    return (F.when(label == "likely_water_dominant", "Brightness suggests mostly water.").when(label == "likely_land_dominant", "Brightness suggests mostly land.")
            .when(label == "mixed_or_indeterminate", "Brightness suggests a mixture.").otherwise("No brightness estimate."))


def environment_answer(term: Column, cover_status: Column, classes: Column, mechanisms: Column, land_water: Column) -> Column:
    """Land cover where it is valid, else measured scattering, else brightness; withheld classes are said to be so."""
    basis = F.coalesce(scattering_sentence(mechanisms), land_water_sentence(land_water))
    named = F.concat(F.lit("Land cover: "), F.array_join(F.slice(classes, 1, 4), ", "), F.lit("."))
    return (F.when((cover_status == "available") & (F.size(classes) > 0), named).when(cover_status == "out_of_domain", F.concat(F.lit("Classes withheld, outside the model's region. "), basis))
            .when(cover_status == "domain_unverified", F.concat(F.lit("Classes withheld, location unknown. "), basis)).when(F.size(mechanisms) > 0, F.concat(F.lit("No class can be named for "), term, F.lit(". "), basis))
            .otherwise(F.concat(F.lit("Cannot confirm "), term, F.lit(". "), basis)))


def scene_description(sensor: Column, acquired: Column, orbit: Column, pols: Column, place: Column, width_km: Column, height_km: Column, water: Column, labels: Column, mechanisms: Column, closing: str = "Everything above is measured or detector-backed.") -> Column:
    """Paragraphs of a scene; what is unknown is left out."""
    first = F.concat(F.concat_ws(", ", F.concat(F.coalesce(sensor, F.lit("Unknown sensor")), F.lit(" scene")), F.concat(F.lit("taken "), acquired), F.concat(orbit, F.lit(" pass")), pols), F.lit("."))
    second = F.concat(F.lit("Centre "), place, F.lit(", about "), F.bround(width_km, 0).cast("int").cast("string"), F.lit(" x "), F.bround(height_km, 0).cast("int").cast("string"), F.lit(" km."))
    third = F.concat(F.lit("Water-like brightness on "), percent(water), F.lit("."))
    fourth = F.concat(F.lit("Detections: "), F.nullif(labels, F.lit("")), F.lit("."))
    return F.concat_ws("\n\n", first, second, third, fourth, scattering_sentence(mechanisms), F.lit(closing))


def answer_route(intent: Column, has_scene: Column, state: Column) -> Column:
    """direct from the record, insufficient, or with retrieved patches."""
    direct = has_scene & (intent.startswith("detector") | (intent == "environment"))
    return F.when(direct, "direct").when(~has_scene & (state == "empty"), "insufficient").when((intent == "visual_evidence") & state.isin("empty", "weak"), "insufficient").when((intent == "scene_description") & has_scene, "described").otherwise("retrieve")
