"""Decision lists: filters, padding, merging, ordering, summaries, and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_token, has_token
from ..schema import ACTIONS, DECISION_COLUMNS, DIALOGUE_SOURCES, FOCAL, MEDIA, SEQ, SUPPORTING_SOURCES, VISUAL_SOURCES
from .ranges import by_media, islands, joined_once, ordered_rows
from .snap import snap


def by_action(edl: DataFrame, action: str) -> DataFrame:
    return edl.where((F.col("action") == action) & F.col("accepted"))


def action_ranges(edl: DataFrame, action: str) -> DataFrame:
    return by_action(edl, action).select(MEDIA, "start", "end")


def pad(edl: DataFrame, seconds: float) -> DataFrame:
    """Wider at both ends; never before 0. The end isn't held to the duration."""
    return edl.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - seconds)).withColumn("end", F.col("end") + seconds)


def span() -> Column:
    """Seconds of a row; 0 where it ends before it starts."""
    return F.greatest(F.lit(0.0), F.col("end") - F.col("start"))


def is_visual_only(source: Column) -> Column:
    return has_token(source, VISUAL_SOURCES) & ~has_token(source, SUPPORTING_SOURCES)


def is_dialogue(source: Column) -> Column:
    return has_token(source, DIALOGUE_SOURCES)


def for_review(edl: DataFrame) -> DataFrame:
    """Accepted cuts of a category worth a look, numbered in order."""
    kept = by_action(edl, "cut").where(has_token(F.col("category"), FOCAL))
    return kept.withColumn("place", F.row_number().over(by_media()))


def renumbered(edl: DataFrame) -> DataFrame:
    """seq in (start, end) order, ties as they were: the order of a sorted list."""
    return edl.withColumn(SEQ, F.row_number().over(by_media("start", "end", SEQ)).cast("bigint") - 1)


def action_rank(action: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(ACTIONS) for x in (a, i)])
    return F.coalesce(F.try_element_at(rank, action), F.raise_error(F.concat(F.lit("unknown action "), F.coalesce(action, F.lit("null")))).cast("int"))


def merge_overlapping(edl: DataFrame, gap: float = 0.0) -> DataFrame:
    """Rows that overlap, or lie within `gap`, as one: the widest span and the strongest action.

    Categories and sources join with +, reasons with ; each only if not already within the text so far.
    Texts and acceptance are those of the first row. Whatever their actions, neighbours merge.
    """
    first = lambda c: F.min_by(c, F.struct("start", SEQ)).alias(c)
    grouped = (
        islands(edl.withColumn("_rank", action_rank(F.col("action"))), gap)
        .groupBy(MEDIA, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max("_rank").alias("_rank"),
            ordered_rows("category", "source", "reason").alias("_rows"),
            first("text_before"),
            first("text_after"),
            first("accepted"),
        )
    )
    text = lambda c, sep, trim=None: joined_once(F.transform("_rows", lambda r: r[c]), sep, trim)
    return grouped.select(
        MEDIA,
        (F.col("island").cast("bigint") - 1).alias(SEQ),
        "start",
        "end",
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("_rank") + 1).alias("action"),
        text("category", "+").alias("category"),
        text("reason", "; ", "; ").alias("reason"),
        "text_before",
        "text_after",
        text("source", "+").alias("source"),
        "accepted",
    )


def summary(edl: DataFrame) -> DataFrame:
    """Accepted rows by action and first category."""
    return edl.where("accepted").groupBy(MEDIA, F.concat_ws(":", "action", first_token(F.col("category"))).alias("key")).agg(F.count("*").alias("n"))


def appended(edl: DataFrame, more: DataFrame) -> DataFrame:
    """edl and then more, in the order of more's seq."""
    both = edl.select(*DECISION_COLUMNS, F.lit(0).alias("_part")).unionByName(more.select(*DECISION_COLUMNS, F.lit(1).alias("_part")))
    return both.withColumn(SEQ, F.row_number().over(by_media("_part", SEQ)).cast("bigint") - 1).drop("_part")


def add_cut(edl: DataFrame, cuts: DataFrame, gap: float = 0.5, shots: DataFrame | None = None) -> DataFrame:
    """Manual rows added, snapped to shots if there are any, and the whole list sorted and merged again. A row must end after it starts."""
    bad = F.raise_error(F.lit("a cut must end after it starts")).cast("double")
    checked = cuts.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(bad)).withColumn("source", F.lit("manual")).withColumn("accepted", F.lit(True))
    if shots is not None:
        checked = snap(checked, shots)
    return merge_overlapping(renumbered(appended(edl, checked)), gap)


def review(edl: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits by (media_id, seq): accept, reject, or trim to (new_start, new_end), both or neither; the last edit of a kind counts.

    edits: media_id, seq, at, verb, new_start, new_end.
    """
    last = Window.partitionBy(MEDIA, SEQ, F.col("verb") == "trim").orderBy(F.desc("at"))
    kept = edits.where("verb in ('accept', 'reject') or (verb = 'trim' and new_start is not null and new_end > new_start and new_start >= 0)").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    flat = kept.groupBy(MEDIA, SEQ).agg(
        F.max(F.when(F.col("verb") != "trim", F.col("verb") == "accept")).alias("_accepted"),
        F.max(F.when(F.col("verb") == "trim", F.col("new_start"))).alias("_start"),
        F.max(F.when(F.col("verb") == "trim", F.col("new_end"))).alias("_end"),
    )
    joined = edl.join(flat, [MEDIA, SEQ], "left")
    return (
        joined.withColumn("start", F.coalesce("_start", "start")).withColumn("end", F.coalesce("_end", "end")).withColumn("accepted", F.coalesce("_accepted", "accepted")).select(DECISION_COLUMNS)
    )
