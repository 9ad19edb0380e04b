"""The timeline that is left when cuts are taken out: kept segments, shifted times, render filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..schema import MEDIA
from .ranges import first_holding, merged

EDGE = 1e-4
SHORTEST = 0.001


def keep_segments(media: DataFrame, cuts: DataFrame) -> DataFrame:
    """(media_id, start, end): what cuts leave of [0, duration], pieces of over a millisecond.

    media: media_id, duration. A cut that starts beyond the duration still ends a piece there.
    """
    rows = cuts.join(media, MEDIA).select(MEDIA, F.greatest(F.lit(0.0), "start").alias("_s"), F.least("end", "duration").alias("_e"), F.col("start").alias("_o"))
    before = Window.partitionBy(MEDIA).orderBy("_o", "_e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.withColumn("_at", F.greatest(F.lit(0.0), F.max("_e").over(before))).where("_e > _at and _s > _at").select(MEDIA, F.col("_at").alias("start"), F.col("_s").alias("end"))
    last = rows.groupBy(MEDIA).agg(F.max("_e").alias("_last"))
    tail = media.join(last, MEDIA, "left").select(MEDIA, F.greatest(F.lit(0.0), F.coalesce("_last", F.lit(0.0))).alias("start"), F.col("duration").alias("end"))
    return gaps.unionByName(tail).where(F.col("end") - F.col("start") > SHORTEST)


def _ordered_cuts(cuts: DataFrame) -> DataFrame:
    """Merged cuts with the seconds that they and those before them take out."""
    upto = Window.partitionBy(MEDIA).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return merged(cuts).withColumn("_gone", F.sum(F.col("end") - F.col("start")).over(upto))


def shift(points: DataFrame, at: str, cuts: DataFrame, name: str) -> DataFrame:
    """points with `at` on the timeline without the cuts; null within a cut (ends included)."""
    known = _ordered_cuts(cuts).select(MEDIA, F.col("start").alias("_key"), F.lit(0).alias("_side"), F.struct("end", "_gone").alias("_cut"))
    rows = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    wanted = points.select(MEDIA, F.col(at).alias("_key"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_cut"].dataType).alias("_cut"), rows.alias("_row"))
    so_far = Window.partitionBy(MEDIA).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = known.withColumn("_row", F.lit(None).cast(wanted.schema["_row"].dataType)).unionByName(wanted)
    last = both.withColumn("_cut", F.last("_cut", ignorenulls=True).over(so_far)).where(F.col("_row").isNotNull())
    t = F.col("_key")
    moved = F.when(F.col("_cut").isNull(), F.greatest(F.lit(0.0), t)).when(t <= F.col("_cut.end"), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), t - F.col("_cut._gone")))
    return last.select("_row.*", F.when(t.isNotNull(), moved).alias(name))


def shift_ranges(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Mutes on the timeline without the cuts: (media_id, seq, start, end).

    A head within a cut begins at 0; a tail within one ends where the cut begins. Ranges wholly within cuts, or that end before they start, are gone.
    """
    rows = shift(shift(ranges, "start", cuts, "_a"), "end", cuts, "_b")
    inside = first_holding(rows.where("_b is null and _a is not null"), "end", cuts, "_c")
    tails = shift(inside.withColumn("_t", F.col("_c.start") - EDGE), "_t", cuts, "_b2").select(MEDIA, "seq", F.col("_a").alias("_s"), F.col("_b2").alias("_e"))
    whole = rows.where("_b is not null").select(MEDIA, "seq", F.coalesce("_a", F.lit(0.0)).alias("_s"), F.col("_b").alias("_e"))
    return whole.unionByName(tails).where("_e > _s").select(MEDIA, "seq", F.col("_s").alias("start"), F.col("_e").alias("end"))


def shift_subtitles(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cues on the timeline without the cuts, numbered anew from 1; an item without cuts keeps its cues and numbers.

    A head within a cut begins just after the first cut that holds it, or at 0 if that is within another one.
    """
    items = cuts.select(MEDIA).distinct().withColumn("_has", F.lit(True))
    marked = cues.join(items, MEDIA, "left")
    untouched = marked.where("_has is null").drop("_has").select(MEDIA, "idx", "start", "end", "text")
    rows = shift(shift(marked.where("_has").drop("_has"), "start", cuts, "_a"), "end", cuts, "_b").where("_a is not null or _b is not null")
    heads = first_holding(rows, "start", cuts, "_h").withColumn("_hp", F.when(F.col("_a").isNull(), F.col("_h.end") + EDGE))
    tails = first_holding(heads, "end", cuts, "_c").withColumn("_tp", F.when(F.col("_b").isNull(), F.col("_c.start") - EDGE))
    placed = shift(shift(tails, "_hp", cuts, "_a2"), "_tp", cuts, "_b2")
    start = F.when(F.col("_a").isNotNull(), F.col("_a")).otherwise(F.coalesce("_a2", F.lit(0.0)))
    moved = placed.withColumn("_s", start).withColumn("_e", F.when(F.col("_b").isNotNull(), F.col("_b")).otherwise(F.coalesce("_b2", "_s"))).where("_e > _s")
    order = Window.partitionBy(MEDIA).orderBy("idx")
    return moved.select(MEDIA, F.row_number().over(order).alias("idx"), F.col("_s").alias("start"), F.col("_e").alias("end"), "text").unionByName(untouched)


def _joined(df: DataFrame, each: Column, separator: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("start", "end")))
    return df.groupBy(MEDIA).agg(ordered.alias("_r")).select(MEDIA, F.array_join(F.transform("_r", lambda r, i: each(r, i)), separator).alias(name), F.size("_r").alias("n"))


def mute_filter(mutes: DataFrame) -> DataFrame:
    """(media_id, filter): an audio filter that is silent in the given ranges."""
    each = lambda r, i: F.concat(F.lit("between(t,"), fixed(r["start"], "0.000"), F.lit(","), fixed(r["end"], "0.000"), F.lit(")"))
    return _joined(mutes, each, "+", "_e").select(MEDIA, F.concat(F.lit("volume=enable='"), "_e", F.lit("':volume=0")).alias("filter"))


def cut_filter(segments: DataFrame) -> DataFrame:
    """(media_id, filter): a filter graph that keeps the segments and joins them."""

    def each(r: Column, i: Column) -> Column:
        a, b, n = fixed(r["start"], "0.000"), fixed(r["end"], "0.000"), i.cast("string")
        part = lambda kind, trim, pts: [F.lit(f"[0:{kind}]{trim}=start="), a, F.lit(":end="), b, F.lit(f",{pts}=PTS-STARTPTS[{kind}"), n, F.lit("]")]
        return F.concat(*part("v", "trim", "setpts"), F.lit(";"), *part("a", "atrim", "asetpts"))

    names = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("[v"), i.cast("string"), F.lit("][a"), i.cast("string"), F.lit("]"))), "")
    graph = _joined(segments, each, ";", "_g")
    return graph.select(MEDIA, F.concat("_g", F.lit(";"), names(F.col("n")), F.lit("concat=n="), F.col("n").cast("string"), F.lit(":v=1:a=1[v][a]")).alias("filter"))


def hardware_quality(quality: int) -> int:
    """A quality of 0 to 51, low is good, on the hardware encoder's scale of 30 to 100."""
    return max(30, min(100, 90 - 2 * quality))


def encoder_arguments(encoder: str, quality: int) -> list[str]:
    """What an ffmpeg command says of the video encoder: the hardware one, or the software one for any other name."""
    if encoder == "videotoolbox":
        return f"-c:v h264_videotoolbox -q:v {hardware_quality(quality)} -b:v 0".split()
    return f"-c:v libx264 -preset slow -crf {quality}".split()


def cut_commands(media: DataFrame, segments: DataFrame, cuts: DataFrame, encoder: str = "libx264", quality: int = 20) -> DataFrame:
    """(media_id, arguments): what an ffmpeg is to be called with to take the cuts out of each item; media: media_id, video_path, output_path.

    An item without cuts is copied; one of which nothing is left is an error.
    """
    has = cuts.select(MEDIA).distinct().withColumn("_has", F.lit(True))
    rows = media.join(has, MEDIA, "left").join(cut_filter(segments), MEDIA, "left")
    words = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    whole = words("-y", "-i", F.col("video_path"), "-c", "copy", F.col("output_path"))
    some = words("-y", "-i", F.col("video_path"), "-filter_complex", F.col("filter"), "-map", "[v]", "-map", "[a]", *encoder_arguments(encoder, quality), "-c:a", "aac", "-b:a", "192k", F.col("output_path"))
    nothing = F.raise_error(F.concat(F.lit("nothing is left of item "), F.col(MEDIA))).cast("array<string>")
    return rows.select(MEDIA, F.when(F.col("_has").isNull(), whole).when(F.col("filter").isNull(), nothing).otherwise(some).alias("arguments"))


def render_plan(edl: DataFrame, cues: DataFrame, media: DataFrame, replacements: dict[str, str]) -> dict[str, DataFrame]:
    """All that an encoder needs: kept segments, mutes and softened cues on the new timeline, and the filters."""
    from ..functions.text import soften
    from .decisions import action_ranges, by_action

    cuts = action_ranges(edl, "cut")
    segments, mutes = keep_segments(media, cuts), shift_ranges(by_action(edl, "mute"), cuts)
    subs = shift_subtitles(cues, cuts).withColumn("text", soften(F.col("text"), replacements))
    return {"segments": segments, "mutes": mutes, "subtitles": subs, "cut_filter": cut_filter(segments), "mute_filter": mute_filter(mutes)}
