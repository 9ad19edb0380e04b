"""Sampled frames: explicit hits, streaks, hits by shot, and which frame a sample is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DECISION_COLUMNS, MEDIA, SEQ
from .ranges import by_media


def explicit_classes(detections: Column, classes: tuple[str, ...], threshold: float) -> Column:
    """Distinct explicit classes of a frame's detections, sorted; a missing score is 0."""
    hit = F.filter(detections, lambda d: d["class"].isin(*classes) & (F.coalesce(d["score"], F.lit(0.0)) >= threshold))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda d: d["class"])))


def explicit_frames(frames: DataFrame, classes: tuple[str, ...], threshold: float = 0.7) -> DataFrame:
    """frames with the explicit classes and whether there are any."""
    return frames.withColumn("classes", F.coalesce(explicit_classes(F.col("detections"), classes, threshold), F.array().cast("array<string>"))).withColumn("hit", F.size("classes") > 0)


def streaks(hits: DataFrame, step: float, least: int = 3) -> DataFrame:
    """Cuts for runs of consecutive hits among the samples of an item that could be read.

    hits: media_id, t, hit, classes. A streak ends one step after its last hit; its length in samples is
    the span over the step, halves to even, and one at least.
    """
    order = Window.partitionBy(MEDIA).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    runs = hits.withColumn("_run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order)).where("hit")
    found = runs.groupBy(MEDIA, "_run").agg(F.min("t").alias("start"), (F.max("t") + step).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    sized = found.withColumn("samples", F.greatest(F.lit(1), F.rint((F.col("end") - F.col("start")) / step).cast("int"))).where(F.col("samples") >= max(1, least))
    return sized.select(MEDIA, "start", "end", "samples", "classes")


def shot_hits(shots: DataFrame, hits: DataFrame, step: float, fraction: float = 0.5, least: int = 2) -> DataFrame:
    """Shots a fraction of whose planned samples hit.

    hits: media_id, t, hit, classes, one row for each sample that could be read; a sample belongs to the
    shot that holds it. Planned: the whole steps in the shot, two at least; none in an empty shot.
    """
    from .ranges import stab

    length = F.col("end") - F.col("start")
    planned = shots.where(length > 0).withColumn("planned", F.greatest(F.lit(2), F.floor(length / step).cast("int")))
    placed = stab(hits.where("hit"), "t", planned, "_s").where(F.col("_s").isNotNull())
    found = placed.groupBy(MEDIA, F.col("_s.shot_idx").alias("shot_idx"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.planned").alias("planned")).agg(
        F.count("*").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes")
    )
    return found.where((F.col("hits") >= least) & (F.col("hits") / F.col("planned") >= fraction))


def planned_samples(shots: DataFrame, step: float) -> DataFrame:
    """(media_id, shot_idx, k, t): the samples planned for each shot, at the middles of equal parts."""
    length = F.col("end") - F.col("start")
    n = F.greatest(F.lit(2), F.floor(length / step).cast("int"))
    rows = shots.where(length > 0).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return rows.select(MEDIA, "shot_idx", "k", (F.col("start") + length * (F.col("k") + 0.5) / F.col("n")).alias("t"))


def frame_numbers(samples: DataFrame, fps: float) -> DataFrame:
    """Which frame each sample is: the nearest, halves to even."""
    return samples.withColumn("frame", F.rint(F.col("t") * fps).cast("bigint"))


def streak_decisions(found: DataFrame, action: str) -> DataFrame:
    """What streaks() finds, as decisions."""
    return _decisions(found, F.concat(F.lit("visual streak ("), "samples", F.lit(" frames): ")), action, "visual")


def shot_decisions(found: DataFrame, action: str) -> DataFrame:
    """What shot_hits() finds, as decisions."""
    return _decisions(found, F.concat(F.lit("shot "), "hits", F.lit("/"), "planned", F.lit(" frames flagged: ")), action, "visual-shot")


def _decisions(found: DataFrame, why: Column, action: str, source: str) -> DataFrame:
    rows = found.withColumn("action", F.lit(action)).withColumn("category", F.lit("nudity")).withColumn("reason", F.concat(why, F.array_join("classes", ", ")))
    rows = rows.withColumns({"text_before": F.lit(""), "text_after": F.lit(""), "source": F.lit(source), "accepted": F.lit(True), SEQ: F.lit(0).cast("bigint")})
    return rows.withColumn(SEQ, F.row_number().over(by_media("start", "end")).cast("bigint") - 1).select(DECISION_COLUMNS)
