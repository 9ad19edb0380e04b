"""Dialogue: line scan, word scan, context gate, and chunks for a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Pattern
from ..functions.text import soften
from ..schema import DECISION_COLUMNS, MEDIA, REASON_CAP, SEQ
from .ranges import by_media, range_exists_within


def _seq(df: DataFrame, *order) -> DataFrame:
    return df.withColumn(SEQ, F.row_number().over(by_media(*order)).cast("bigint") - 1)


def scan_lines(cues: DataFrame, lexicon: list[Pattern], actions: dict[str, str], replacements: dict[str, str] | None = None, window: float | None = 30.0) -> DataFrame:
    """A decision for each cue with a match.

    The best match decides: strong before weak, then the more severe category, then the vocabulary's order.
    A category without an action is muted. Where the action is keep, the whole cue has none. The reason lists the distinct texts of all matches.
    Weak decisions then need a strong one within `window` seconds; None leaves them.
    """
    if not lexicon:
        return cues.sparkSession.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _empty(cues)))
    # one cheap look over all patterns before each is taken alone
    any_of = "(?iuU)" + "|".join(f"(?:{p.regex})" for p in lexicon)

    def hits_of(p: Pattern) -> Column:
        rank = [F.lit(0 if p.strong else 1).alias("weak"), F.lit(-p.severity).alias("mild"), F.lit(p.place).alias("place")]
        what = [F.lit(p.category).alias("category"), F.lit(actions.get(p.category, "mute")).alias("action")]
        return F.transform(F.regexp_extract_all("text", F.lit(p.java), F.lit(0)), lambda m: F.struct(*rank, *what, F.lower(m).alias("text")))

    hits = [hits_of(p) for p in lexicon]
    found = cues.where(F.col("text").rlike(any_of)).withColumn("_hits", F.flatten(F.array(*hits))).where(F.size("_hits") > 0)
    best = found.withColumn("_best", F.array_min("_hits")).where(F.col("_best.action") != "keep")
    words = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["text"]))), ", ")
    rows = best.select(
        MEDIA,
        "start",
        "end",
        F.col("_best.action").alias("action"),
        F.col("_best.category").alias("category"),
        F.concat(F.when(F.col("_best.weak") == 1, "weak: ").otherwise("matched: "), words).alias("reason"),
        F.col("text").alias("text_before"),
        soften(F.col("text"), replacements or {}).alias("text_after"),
        F.lit("subtitle").alias("source"),
        F.lit(True).alias("accepted"),
        F.col("idx").alias("_at"),
    )
    rows = _seq(rows, "start", "_at").select(DECISION_COLUMNS)
    return rows if window is None else context_gate(rows, window)


def _empty(cues: DataFrame):
    from pyspark.sql.types import _parse_datatype_string

    from ..schema import DECISION

    return _parse_datatype_string(DECISION).fields


def scan_words(words: DataFrame, lexicon: list[Pattern], actions: dict[str, str], replacements: dict[str, str] | None = None, window: float | None = 30.0) -> DataFrame:
    """Decisions from word timings: from each word the run of one, two or three words that first has a match to act on.

    The match may lie anywhere in the run, so that a word also fires for runs that begin one or two words
    before it. The more severe category decides, then strong before weak, then the vocabulary's order;
    a run that is empty, or whose action is keep, leaves it to the next longer one. A category without an
    action is muted. The reason names what the deciding pattern matched, not the run.
    """
    order = by_media("pos")
    lead = lambda c, n: F.lead(c, n).over(order)
    ahead = words.withColumns({"_t1": lead("text", 1), "_t2": lead("text", 2), "_e1": lead("end", 1), "_e2": lead("end", 2)})

    def run(parts: list[str], end: str) -> Column:
        whole = reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(p) for p in parts])
        text = F.btrim(whole, F.lit(" .,!?-"))
        hits = F.array_compact(
            F.array(
                *[
                    F.when(
                        text.rlike(p.java),
                        F.struct(F.lit(-p.severity).alias("mild"), F.lit(0 if p.strong else 1).alias("weak"), F.lit(p.place).alias("place"), F.lit(p.category).alias("category"), F.lit(actions.get(p.category, "mute")).alias("action"), F.lower(F.regexp_extract(text, p.java, 0)).alias("matched")),
                    )
                    for p in lexicon
                ]
            )
        )
        best = F.array_min(hits)
        ok = whole.isNotNull() & (text != "") & (best["action"] != "keep")
        return F.when(ok, F.struct(best.alias("best"), text.alias("text"), F.col(end).alias("end")))

    if not lexicon:
        return words.select(MEDIA).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _empty(words)])
    first = F.coalesce(run(["text"], "end"), run(["text", "_t1"], "_e1"), run(["text", "_t1", "_t2"], "_e2"))
    rows = ahead.withColumn("_r", first).where(F.col("_r").isNotNull())
    label = F.concat(F.when(F.col("_r.best.weak") == 1, "weak: ").otherwise("matched: "), F.col("_r.best.matched"))
    out = rows.select(
        MEDIA,
        "start",
        F.col("_r.end").alias("end"),
        F.col("_r.best.action").alias("action"),
        F.col("_r.best.category").alias("category"),
        label.alias("reason"),
        F.col("_r.text").alias("text_before"),
        soften(F.col("_r.text"), replacements or {}).alias("text_after"),
        F.lit("whisper-word").alias("source"),
        F.lit(True).alias("accepted"),
        F.col("pos").alias("_at"),
    )
    out = _seq(out, "_at").select(DECISION_COLUMNS)
    return out if window is None else context_gate(out, window)


def context_gate(edl: DataFrame, window: float = 30.0) -> DataFrame:
    """Weak rows stay only within `window` seconds of a strong one; strong rows always do."""
    weak = F.startswith(F.col("reason"), F.lit("weak:"))
    near = range_exists_within(edl, ~weak, window, "_near")
    return near.where(~weak | F.col("_near")).drop("_near")


def chunk_lines(cues: DataFrame, gap: float = 6.0, span: float = 90.0, least: int = 2) -> DataFrame:
    """Greedy chunks of cues in order: a new one after a gap, or where a chunk would span too long; short ones are dropped.

    A chunk ends where its last cue does. Where it breaks hangs on where it began, so this is a fold
    over one item's cues; columns: media_id, chunk, start, end, lines (array of idx, start, end, text).
    """
    items = F.sort_array(F.collect_list(F.struct("idx", "start", "end", "text")))
    zero = F.struct(F.array().cast("array<int>").alias("breaks"), F.lit(0).alias("i"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["i"] == 0) | (x["start"] - acc["last"] > gap) | (x["end"] - acc["first"] > span)
        breaks = F.when(new, F.concat(acc["breaks"], F.array(acc["i"]))).otherwise(acc["breaks"])
        return F.struct(breaks.alias("breaks"), (acc["i"] + 1).alias("i"), F.when(new, x["start"]).otherwise(acc["first"]).alias("first"), x["end"].alias("last"))

    # the fold carries where chunks begin, not the cues
    folded = cues.groupBy(MEDIA).agg(items.alias("_items")).withColumn("_b", F.aggregate("_items", zero, step, lambda acc: acc["breaks"]))
    cut = F.transform("_b", lambda at, k: F.slice("_items", at + 1, F.coalesce(F.get("_b", k + 1), F.size("_items")) - at))
    chunks = folded.select(MEDIA, F.posexplode(F.filter(cut, lambda c: F.size(c) >= least)).alias("chunk", "lines"))
    return chunks.select(MEDIA, "chunk", F.col("lines")[0]["start"].alias("start"), F.element_at("lines", -1)["end"].alias("end"), "lines")


def review_context(edl: DataFrame, cues: DataFrame, most: int = 10, stretch: int = 64) -> DataFrame:
    """(media_id, seq, place, idx, text): the first cues, by idx, that overlap each row, touching ones not.

    An item's cues are gathered once, in stretches of so many by start, and each of its rows looks through the stretches that
    it overlaps: either side is shuffled once, and no pair is.
    """
    number = F.row_number().over(by_media("start", "idx"))
    placed = cues.where("start is not null and end is not null").withColumn("_stretch", F.floor((number - 1) / stretch))
    parts = placed.groupBy(MEDIA, "_stretch").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.collect_list(F.struct("idx", "start", "end", "text")).alias("cues"))
    said = parts.groupBy(MEDIA).agg(F.collect_list(F.struct("lo", "hi", "cues")).alias("_parts"))
    within = lambda lo, hi: (lo < F.col("_b")) & (hi > F.col("_a"))
    near = F.flatten(F.transform(F.filter("_parts", lambda p: within(p["lo"], p["hi"])), lambda p: F.filter(p["cues"], lambda c: within(c["start"], c["end"]))))
    rows = edl.select(MEDIA, SEQ, F.col("start").alias("_a"), F.col("end").alias("_b")).join(said, MEDIA)
    met = rows.select(MEDIA, SEQ, F.posexplode(F.slice(F.sort_array(near), 1, most)).alias("_k", "_c"))
    return met.select(MEDIA, SEQ, (F.col("_k") + 1).alias("place"), "_c.idx", "_c.text")


def capped(reason: Column, most: int = REASON_CAP) -> Column:
    return F.substring(reason, 1, most)
