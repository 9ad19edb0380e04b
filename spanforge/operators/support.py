"""Corroboration: rows that only pictures speak for need another kind of evidence nearby."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_token
from ..schema import SUPPORTING_SOURCES
from .decisions import is_visual_only
from .ranges import range_exists_within


def mark_unsupported(edl: DataFrame, radius: float = 5.0) -> DataFrame:
    """Accepted visual-only rows without an accepted supporting row within `radius` are no longer accepted, and say why."""
    near = range_exists_within(edl, F.col("accepted") & has_token(F.col("source"), SUPPORTING_SOURCES), radius, "_near")
    alone = F.col("accepted") & is_visual_only(F.col("source")) & ~F.col("_near")
    reason = F.substring(F.concat(F.lit("[solo-visual; needs corroboration] "), F.col("reason")), 1, 200)
    return near.withColumn("reason", F.when(alone, reason).otherwise(F.col("reason"))).withColumn("accepted", F.col("accepted") & ~alone).select(edl.columns)
