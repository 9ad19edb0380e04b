"""Subtitle files, word sidecars and decision documents as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..schema import EDL_DOCUMENT, MEDIA, SEQ

STAMP = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
CUE = rf"(?s)^\s*(\d+)[^\S\n]*\n\s*{STAMP}[^\S\n]*-->[^\S\n]*{STAMP}[^\n]*\n?(.*)$"


def _media(path: str | None) -> Column:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return name if path is None else F.regexp_extract(name, path, 1)


def read_srt(spark: SparkSession, path: str, media: str | None = r"(\d+)\.srt$") -> DataFrame:
    """Cues of SRT files: (media_id, idx, start, end, text). media: a pattern whose group is the item's id in the file name, unless the folders say it as write_srt's do.

    Blocks that aren't cues are left out; bytes that aren't UTF-8 become U+FFFD.
    """
    whole = spark.read.text(path, wholetext=True)
    item = F.col(MEDIA) if MEDIA in whole.columns else _media(media)
    return parse_srt(whole.select(item.cast("bigint").alias(MEDIA), "value"))


def parse_srt(documents: DataFrame) -> DataFrame:
    """Cues of SRT texts (media_id, value)."""
    plain = F.regexp_replace(F.regexp_replace("value", "\ufeff", ""), "\r\n?", "\n")
    blocks = documents.select(MEDIA, F.explode(F.split(plain, r"\n[^\S\n]*\n(?=\s*\d+[^\S\n]*\n\s*\d+:)")).alias("b"))
    part = lambda i: F.regexp_extract("b", CUE, i)
    seconds = lambda i: part(i).cast("double") * 3600 + part(i + 1).cast("double") * 60 + part(i + 2).cast("double") + F.rpad(part(i + 3), 3, "0").cast("double") / 1000
    cues = blocks.where(F.col("b").rlike(CUE))
    return cues.select(MEDIA, part(1).cast("int").alias("idx"), seconds(2).alias("start"), seconds(6).alias("end"), F.rtrim(part(10), F.lit("\n ")).alias("text"))


def srt_time(seconds: Column) -> Column:
    ms = F.rint(seconds * 1000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.when(hours < 10, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000)), F.lit(":"),
        two(F.floor(F.pmod(ms, F.lit(60_000)) / 1000)), F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"),
    )


def srt_documents(cues: DataFrame) -> DataFrame:
    """(media_id, value): the SRT text of each item, cues by start and numbered from 1."""
    one = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c["start"]), F.lit(" --> "), srt_time(c["end"]), F.lit("\n"), c["text"], F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("start", "end", "idx", "text")))
    return cues.groupBy(MEDIA).agg(ordered.alias("_c")).select(MEDIA, F.array_join(F.transform("_c", one), "\n").alias("value"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One folder for each item with a text file in it."""
    srt_documents(cues).repartition(MEDIA).write.mode("overwrite").partitionBy(MEDIA).option("lineSep", "\n").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """(media_id, value) of any kind of document, many items in a file: one file each, as write_srt and write_edl make for handing out, takes some 5 ms an item to make, commit, list and open."""
    documents.write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("media_id bigint, value string").parquet(path)


def edl_documents(edl: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, value): each item's decisions as a JSON document, in order. media: media_id, video_path, subtitle_path."""
    fields = ["start", "end", "action", "category", "reason", "text_before", "text_after", "source", "accepted"]
    rows = edl.groupBy(MEDIA).agg(F.sort_array(F.collect_list(F.struct(SEQ, F.struct(*fields).alias("d")))).alias("_d"))
    document = F.to_json(F.struct("video_path", "subtitle_path", F.transform("_d", lambda x: x["d"]).alias("decisions")))
    return media.join(rows, MEDIA).select(MEDIA, document.alias("value"))


def parse_edl(documents: DataFrame) -> DataFrame:
    """Decisions of JSON documents (media_id, value); what a row doesn't say has its default: empty texts, accepted."""
    parsed = documents.select(MEDIA, F.from_json("value", EDL_DOCUMENT).alias("e")).select(MEDIA, F.posexplode("e.decisions").alias("_p", "d"))
    text = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit("")).alias(c)
    return parsed.select(MEDIA, F.col("_p").cast("bigint").alias(SEQ), "d.start", "d.end", "d.action", "d.category", text("reason"), text("text_before"), text("text_after"), text("source"), F.coalesce("d.accepted", F.lit(True)).alias("accepted"))


def write_edl(edl: DataFrame, media: DataFrame, path: str) -> None:
    edl_documents(edl, media).repartition(MEDIA).write.mode("overwrite").partitionBy(MEDIA).text(path)


def read_edl(spark: SparkSession, path: str) -> DataFrame:
    return parse_edl(spark.read.option("wholetext", True).text(path).select(F.col(MEDIA).cast("bigint").alias(MEDIA), "value"))


def parse_words(documents: DataFrame) -> DataFrame:
    """Words of sidecar documents (media_id, value); one that doesn't parse has none."""
    kind = "array<struct<start:double,end:double,text:string,probability:double>>"
    rows = documents.select(MEDIA, F.posexplode(F.from_json("value", kind)).alias("_p", "w"))
    return rows.select(MEDIA, F.col("_p").cast("bigint").alias("pos"), "w.start", "w.end", "w.text", F.coalesce("w.probability", F.lit(1.0)).alias("probability")).where("start is not null and `end` is not null and text is not null")


def word_documents(words: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("pos", F.struct("start", "end", "text", "probability").alias("w"))))
    return words.groupBy(MEDIA).agg(rows.alias("_w")).select(MEDIA, F.to_json(F.transform("_w", lambda x: x["w"])).alias("value"))
