"""Audio events: labels to decisions, and slices of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..schema import MEDIA
from .verdicts import as_decisions


def audio_labels(clips: DataFrame, labels: dict[str, str], threshold: float = 0.45, least: float = 1.0, action: str = "cut") -> DataFrame:
    """Decisions for shots whose scores name a known label: categories, and the label with the highest score as the reason.

    clips: media_id, start, end, scores (array of label, score). Shots shorter than `least` are left out.
    """
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])
    hit = F.filter("scores", lambda s: s["label"].isin(*labels) & (s["score"] >= threshold))
    ranked = F.array_sort(F.transform(hit, lambda s, i: F.struct((-s["score"]).alias("low"), i.alias("i"), s["label"].alias("label"), s["score"].alias("score"))))
    rows = clips.where(F.col("end") - F.col("start") >= least).withColumn("_hit", ranked).where(F.size("_hit") > 0)
    top = F.col("_hit")[0]
    found = rows.select(
        MEDIA,
        "start",
        "end",
        F.lit(action).alias("action"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hit", lambda s: table[s["label"]]))), "+").alias("category"),
        F.concat(F.lit("audio event: "), top["label"], F.lit(" ("), fixed(top["score"], "0.00"), F.lit(")")).alias("reason"),
    )
    return as_decisions(found, "audio")


def audio_slice(samples: Column, rate: int, centre: Column, seconds: float) -> Column:
    """`seconds` of samples around a moment; never from before the beginning, and zeros after the end."""
    n = round(seconds * rate)
    begin = F.greatest(F.lit(0.0), centre - seconds / 2)
    start, end = F.rint(begin * rate).cast("int"), F.rint((begin + seconds) * rate).cast("int")
    part = F.slice(samples, start + 1, end - start)
    kind = "array<double>"
    return F.concat(part.cast(kind), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(part))))
