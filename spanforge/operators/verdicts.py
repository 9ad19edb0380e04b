"""Model verdicts: what a language or vision model's answer leads to, and which shots it is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, confidence, is_true, truthy, verdict
from ..schema import DECISION_COLUMNS, MEDIA, REASON_CAP, SEQ
from .ranges import by_media, range_exists

VISION_KEYS = (("intimate", "sex"), ("explicit", "nudity"), ("drug_use", "drugs"), ("violence", "violence"))


#: What a vision verdict is cut for, unless told otherwise: intimate scenes are borderline.
CUT_ON = ("explicit", "drug_use", "violence")


def as_decisions(rows: DataFrame, source: str) -> DataFrame:
    """rows (media_id, start, end, action, category, reason) as accepted decisions of a source, numbered by time."""
    rows = rows.withColumns({"text_before": F.lit(""), "text_after": F.lit(""), "source": F.lit(source), "accepted": F.lit(True)})
    return rows.withColumn(SEQ, F.row_number().over(by_media("start", "end", "category", "reason")).cast("bigint") - 1).select(DECISION_COLUMNS)


def vision_verdicts(answers: DataFrame, model: str, cut_on: tuple[str, ...] = CUT_ON, least: float = 0.55) -> DataFrame:
    """Decisions of frame verdicts: the shot (start, end) of an answer (raw) with flagged categories is cut."""
    flagged = flagged_categories(answers, cut_on, least).where(F.size("flagged") > 0)
    says = F.coalesce(F.try_variant_get(verdict(F.col("raw")), "$.description", "string"), F.lit(""))
    rows = flagged.select(
        MEDIA,
        "start",
        "end",
        F.lit("cut").alias("action"),
        F.array_join("flagged", "+").alias("category"),
        F.concat(F.lit(f"VLM ({model}) "), F.array_join("flagged", ","), F.lit(": "), F.substring(says, 1, REASON_CAP)).alias("reason"),
    )
    return as_decisions(rows, "vlm")


def flagged_categories(answers: DataFrame, cut_on: tuple[str, ...] = CUT_ON, least: float = 0.55) -> DataFrame:
    """answers (raw JSON text) with the categories that a sure enough verdict holds true, in the order of cut_on."""
    names = dict(VISION_KEYS)

    def flags(v: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(is_true(v, k), F.lit(names[k])) for k in cut_on]))
        return F.when(v.isNotNull() & (confidence(v) >= least), found).otherwise(F.array().cast("array<string>"))

    return answers.withColumn("flagged", bound(verdict(F.col("raw")), flags))


def dialogue_verdicts(answers: DataFrame, model: str, least: float = 0.6, pad: float = 1.0) -> DataFrame:
    """Decisions of chunk verdicts that call for a cut.

    The category is multi if not given; profanity is never cut here, and unknown categories, null among them, aren't either.
    """
    known = ("drugs", "sex", "violence", "multi")

    def fields(v: Column) -> Column:
        text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
        sure = v.isNotNull() & truthy(v, "should_cut") & (confidence(v) >= least)
        given = F.try_variant_get(v, "$.category", "variant").isNotNull()
        return F.struct(sure.alias("sure"), F.when(given, text("category")).otherwise("multi").alias("category"), F.coalesce(text("reasoning"), F.lit("")).alias("why"))

    read = answers.withColumn("_f", bound(verdict(F.col("raw")), fields))
    named = read.where(F.col("_f.sure") & F.col("_f.category").isin(*known)).withColumn("category", F.col("_f.category"))
    why = F.col("_f.why")
    rows = named.select(
        MEDIA,
        F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"),
        (F.col("end") + pad).alias("end"),
        F.lit("cut").alias("action"),
        "category",
        F.concat(F.lit(f"LLM ({model}): "), F.substring(why, 1, REASON_CAP)).alias("reason"),
    )
    return as_decisions(rows, "llm-dialogue")


def silent_shots(shots: DataFrame, cues: DataFrame) -> DataFrame:
    """Shots that no cue overlaps; touching isn't overlapping."""
    return range_exists(shots, cues, strict=True, name="_talk").where("not _talk").drop("_talk")


def gap_shots(shots: DataFrame, edl: DataFrame, radius: float = 30.0) -> DataFrame:
    """Shots within `radius` of a mute or cut, accepted or not."""
    flagged = edl.where(F.col("action").isin("mute", "cut")).select(MEDIA, "start", "end")
    return range_exists(shots, flagged, radius, strict=True, name="_close").where("_close").drop("_close")


def select_shots(shots: DataFrame, cues: DataFrame, edl: DataFrame, mode: str = "silent+gaps", radius: float = 30.0, least: float = 0.4, stride: int = 1) -> DataFrame:
    """Shots to ask a vision model about: all, every nth, or those that are silent or near something flagged, or both."""
    long = shots.where(F.col("end") - F.col("start") >= least)
    if mode == "all":
        return long
    if mode == "stride":
        return long.withColumn("_n", F.row_number().over(by_media("start", "end"))).where((F.col("_n") - 1) % stride == 0).drop("_n")
    wanted = mode.split("+")
    if not wanted or set(wanted) - {"silent", "gaps"}:
        raise ValueError(f"mode {mode!r}")
    rows, keep = long, F.lit(False)
    if "silent" in wanted:
        rows, keep = range_exists(rows, cues, strict=True, name="_talk"), keep | ~F.col("_talk")
    if "gaps" in wanted:
        flagged = edl.where(F.col("action").isin("mute", "cut")).select(MEDIA, "start", "end")
        rows, keep = range_exists(rows, flagged, radius, strict=True, name="_close"), keep | F.col("_close")
    return rows.where(keep).select(long.columns)
