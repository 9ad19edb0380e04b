"""Cuts widened to whole shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import stab


def snap(edl: DataFrame, shots: DataFrame) -> DataFrame:
    """Each cut from the start of the shot that holds its start to the end of the one that holds its end.

    Where no shot does, that end stays. Every cut is marked, moved or not; without shots for any item nothing changes,
    and an item without shots keeps its cuts as they are.
    """
    known = shots.select("media_id", "start", "end")
    columns = edl.columns
    probe = edl.withColumn("_last", F.greatest(F.col("start"), F.col("end") - 1e-6))
    held = stab(stab(probe, "start", known, "_a"), "_last", known, "_b")
    items = known.select("media_id").distinct().withColumn("_has", F.lit(True))
    moved = held.join(items, "media_id", "left").withColumn("_cut", F.coalesce((F.col("action") == "cut") & F.col("_has"), F.lit(False)))
    return (
        moved.withColumn("start", F.when(F.col("_cut"), F.coalesce("_a.start", "start")).otherwise(F.col("start")))
        .withColumn("end", F.when(F.col("_cut"), F.coalesce("_b.end", "end")).otherwise(F.col("end")))
        .withColumn("reason", F.when(F.col("_cut"), F.btrim(F.concat(F.col("reason"), F.lit(" | snapped-to-shot")), F.lit(" |"))).otherwise(F.col("reason")))
        .select(columns)
    )
