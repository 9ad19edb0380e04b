"""Reports over a decision list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duration, first_token, fixed, timestamp
from ..schema import CATEGORIES, MEDIA, REASON_CAP, SEQ
from .decisions import span
from .ranges import by_media


def seconds_of(wanted: Column) -> Column:
    """The seconds of a group's wanted rows, added in the order of seq: the last digit of a sum of doubles hangs on the order, and with it what a text says of a whole minute."""
    spans = F.sort_array(F.collect_list(F.when(wanted, F.struct(SEQ, span().alias("s")))))
    return F.aggregate(spans, F.lit(0.0), lambda total, x: total + x["s"])


def totals(edl: DataFrame, media: DataFrame) -> DataFrame:
    """Counts and seconds by action among accepted rows, rejected rows, and the share of the duration that is cut (overlaps count twice)."""
    done = F.col("accepted")
    is_ = lambda a: done & (F.col("action") == a)
    sums = edl.groupBy(MEDIA).agg(
        F.count_if(is_("mute")).alias("n_mute"),
        F.count_if(is_("cut")).alias("n_cut"),
        F.count_if(is_("keep")).alias("n_keep"),
        F.count_if(~done).alias("n_rejected"),
        seconds_of(is_("mute")).alias("t_mute"),
        seconds_of(is_("cut")).alias("t_cut"),
    )
    return sums.join(media, MEDIA).withColumn("removed", F.when(F.col("duration") > 0, 100 * F.col("t_cut") / F.col("duration")).otherwise(F.lit(0.0)))


def by_category(edl: DataFrame) -> DataFrame:
    """Accepted rows and their seconds by first category, ranked by count, then by first appearance."""
    sums = edl.where("accepted").groupBy(MEDIA, first_token(F.col("category")).alias("category")).agg(F.count("*").alias("n"), seconds_of(F.lit(True)).alias("seconds"), F.min(SEQ).alias("_first"))
    order = Window.partitionBy(MEDIA).orderBy(F.desc("n"), "_first")
    return sums.withColumn("place", F.row_number().over(order)).drop("_first")


def top_phrases(edl: DataFrame, most: int = 15) -> DataFrame:
    """The phrases that accepted rows name most often, those named first before others as frequent: (media_id, phrase, n, place)."""
    rows = edl.where(F.col("accepted") & (F.col("text_before") != "") & F.startswith(F.col("reason"), F.lit("matched:")))
    phrases = rows.select(MEDIA, SEQ, F.posexplode(F.transform(F.split(F.substring("reason", len("matched:") + 1, 1 << 30), ","), lambda p: F.lower(F.trim(p)))).alias("_k", "phrase"))
    counts = phrases.where("phrase <> ''").groupBy(MEDIA, "phrase").agg(F.count("*").alias("n"), F.min(F.struct(SEQ, "_k")).alias("_first"))
    order = Window.partitionBy(MEDIA).orderBy(F.desc("n"), "_first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_first")


def decision_list(edl: DataFrame, most: int = REASON_CAP) -> DataFrame:
    """Accepted rows, numbered from 1, with what to show of each: its first category, and the text before and after, or the reason where there is no text."""
    kept = edl.where("accepted")
    flat = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    said, new = F.col("text_before") != "", flat("text_after")
    stamp = lambda c: timestamp(F.greatest(F.lit(0.0), c))
    return kept.select(
        MEDIA,
        F.row_number().over(by_media()).alias("place"),
        stamp("start").alias("from_"),
        stamp("end").alias("to_"),
        F.upper("action").alias("action"),
        first_token(F.col("category")).alias("category"),
        F.when(said, F.substring(flat("text_before"), 1, most)).alias("before"),
        F.when(said & (new != "") & (new != flat("text_before")), F.substring(new, 1, most)).alias("after"),
        F.when(~said & (F.col("reason") != ""), F.substring("reason", 1, most)).alias("reason"),
    )


def padded(value: Column, n: int, left: bool = False) -> Column:
    """The text with spaces up to n characters, never cut."""
    text = value.cast("string")
    spaces = F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(text)))
    return F.concat(spaces, text) if left else F.concat(text, spaces)


def report_lines(edl: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, part, line, text): the report of each item, to be written in this order.

    Part 0 names the item, 1 sums up, 2 has the categories, 3 the phrases, 4 every accepted decision. An item without any has one line
    in place of all but the first part. media: media_id, video_path, duration (null or 0: the length isn't told).
    """

    def lines(rows: DataFrame, part: int, *texts: Column) -> DataFrame:
        made = F.posexplode(F.array_compact(F.array(*texts))).alias("_k", "text")
        return rows.select(MEDIA, F.lit(part).alias("part"), F.col("place").alias("_p"), made).select(MEDIA, "part", (F.col("_p") * 10 + F.col("_k")).cast("long").alias("line"), "text")

    say = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    t = totals(edl, media).withColumn("place", F.lit(0)).withColumn("total", F.col("n_mute") + F.col("n_cut") + F.col("n_keep"))
    some, long = t.where("total > 0"), F.col("duration") > 0
    after = F.greatest(F.lit(0.0), F.col("duration") - F.col("t_cut"))
    names = media.withColumn("place", F.lit(0))
    quiet = names.join(some.select(MEDIA), MEDIA, "left_anti")
    summary = [
        say("Decisions: ", F.col("total").cast("string")),
        say("Mutes:     ", F.col("n_mute").cast("string"), "  (", duration(F.col("t_mute")), " of audio)"),
        say("Cuts:      ", F.col("n_cut").cast("string"), "  (", duration(F.col("t_cut")), " of video)"),
        F.when(long, say("Length:    ", duration(F.col("duration")), ", after cuts ", duration(after), "  (", fixed(F.col("removed"), "0.0"), "% removed)")),
    ]
    parts = [
        lines(names, 0, say("Source: ", F.coalesce("video_path", F.lit("")))),
        lines(quiet, 1, F.lit("Nothing is flagged.")),
        lines(some, 1, *summary),
        lines(by_category(edl), 2, say(padded(F.col("category"), 10), "  ", padded(F.col("n"), 4, True), "  (", duration(F.col("seconds")), ")")),
        lines(top_phrases(edl), 3, say(padded(F.col("n"), 4, True), "  ", F.col("phrase"))),
        lines(
            decision_list(edl),
            4,
            say("[", padded(F.col("place"), 3, True), "] ", F.col("from_"), " - ", F.col("to_"), "  ", padded(F.col("action"), 4), "  ", F.col("category")),
            say("before: ", F.col("before")),
            say("after:  ", F.col("after")),
            say("reason: ", F.col("reason")),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_lines(media: DataFrame, files: DataFrame, streams: DataFrame, settings, lexicon: list, explicit: DataFrame | None = None, prefer: str = "eng", transcribe: bool = True, visual: bool = True, scenes: bool = True, burn: bool = False) -> DataFrame:
    """(media_id, part, line, text): what a run would do to each item, before it is run.

    Part 0 names the item and says where its cues come from: the file asked for (explicit: media_id, path), the best sidecar,
    an embedded text track, or the transcription of an audio track. Parts 1 to 3, the same for all, say what is touched, which
    detectors are on, and how it is rendered.
    """
    from ..sources.media import TEXT_CODECS, pick_audio, pick_embedded_subtitle, pick_sidecar, streams_of

    named = lambda df, name, *cs: df.select(MEDIA, F.struct(*cs).alias(name))
    asked = named(explicit, "_file", "path") if explicit is not None else named(media.where("false"), "_file", F.lit("").alias("path"))
    bitmap = streams_of(streams, "subtitle").groupBy(MEDIA).agg(F.count_if(F.col("codec_name").isin(*TEXT_CODECS)).alias("texts"), F.count_if(~F.col("codec_name").isin(*TEXT_CODECS)).alias("pictures"))
    rows = media.select(MEDIA, "video_path")
    for df in (asked, named(pick_sidecar(files, prefer), "_side", "name"), named(pick_embedded_subtitle(streams, prefer), "_sub", "index", "codec_name", "language"), named(pick_audio(streams, prefer), "_audio", "index", "codec_name", "language"), bitmap):
        rows = rows.join(df, MEDIA, "left")
    track = lambda c: F.concat(F.lit("stream "), F.col(f"{c}.index").cast("string"), F.lit(" ("), F.col(f"{c}.codec_name"), F.lit(", "), F.col(f"{c}.language"), F.lit(")"))
    words = "with word times" if settings.stt_words else "without word times"
    heard = F.when(F.lit(not transcribe), "none, and transcription is off").when(F.col("_audio").isNull(), "none, and no audio to transcribe").otherwise(F.concat(F.lit("transcription of "), track("_audio"), F.lit(f" by {settings.stt_model} {words}")))
    skipped = F.when((F.col("pictures") > 0) & (F.col("texts") == 0), F.concat(F.col("pictures").cast("string"), F.lit(" picture subtitle(s) skipped; "))).otherwise("")
    cues = F.when(F.col("_file").isNotNull(), F.concat(F.lit("the file asked for, "), F.col("_file.path"))).when(F.col("_side").isNotNull(), F.concat(F.lit("sidecar "), F.col("_side.name"))).when(F.col("_sub").isNotNull(), F.concat(F.lit("embedded "), track("_sub"))).otherwise(F.concat(skipped, heard))
    own = [(0, 0, F.concat(F.lit("Source: "), F.coalesce("video_path", F.lit("")))), (0, 1, F.concat(F.lit("Cues: "), cues))]
    shared: list[tuple[int, str]] = []
    for c in CATEGORIES:
        action = settings.actions.get(c, "keep")
        on = c in settings.enabled and action != "keep"
        count = "frames" if c == "nudity" else f"{sum(p.category == c for p in lexicon)} patterns"
        shared.append((1, f"{c}: {action} ({count})" if on else f"{c}: keep (off)"))
    yes = lambda x: "on" if x else "off"
    shared += [
        (2, f"shots: {yes(scenes)} (threshold {settings.scene_threshold})"),
        (2, f"frames: {yes(visual)} (every {settings.sample_seconds} s, threshold {settings.frame_threshold}, share of a shot {settings.hit_fraction})"),
        (2, f"cuts to whole shots: {yes(settings.snap)}"),
        (3, f"encoder: {settings.resolved_encoder()} (quality {settings.quality})"),
        (3, f"subtitles in the picture: {'softened' if burn else 'none'}"),
    ]
    texts = [*own, *((part, k, F.lit(text)) for k, (part, text) in enumerate(shared))]
    made = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("line"), t.alias("text")) for p, k, t in texts])).alias("x")
    return rows.select(MEDIA, made).select(MEDIA, "x.*")
