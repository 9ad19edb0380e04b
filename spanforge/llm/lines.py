"""Line deduplication in DataFrame operations only.

Lines are exploded, their normalised keys hashed to 128 bits, distinct documents
counted per hash, and the lines of frequent hashes dropped by position. A
document's text moves once, to meet the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, cut, let, skew_join


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def hashes(key: Column) -> list[Column]:
    """128 bits of a key as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, sum, drops): for rows (id, sum, text), the positions of the lines each one loses, where it loses any."""
    lines = (
        rows.select("id", "sum", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "sum", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "sum", "pos", *hashes(F.col("key")))
    )
    found = (
        lines.groupBy("h1", "h2", "id")
        .agg(F.count("*").alias("rows"))
        .groupBy("h1", "h2")
        .agg(F.count("id").alias("docs"), F.sum("rows").alias("rows"), F.max("id").alias("last"))
    )
    frequent = cut(found.where(F.col("docs") >= min_docs))
    return (
        skew_join(lines, frequent, ["h1", "h2"], "rows")
        .where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "sum")
        .agg(F.collect_set("pos").alias("drops"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key of at least min_chars code points is found in at least min_docs documents.

    The document with the largest doc_id that holds a key keeps its lines, repeats included; every other one loses
    them. Returns the columns of docs with text replaced, and n_lines and n_dropped (which replace
    columns of these names). A null or empty text is one empty line and comes back empty. Rows of
    one doc_id count as one document; a null doc_id counts as none and always loses frequent lines.
    Repeated rows come back as often as they are given; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("sum"), F.col("row.text").alias("text")
    )
    drops = dropped_positions(rows.select("id", "sum", "text"), min_chars, min_docs).select(F.col("id").alias("id_"), F.col("sum").alias("sum_"), "drops")
    joined = rows.drop("text").join(drops, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sum") == F.col("sum_")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    left = let(
        split_lines(text),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops")), lambda i: F.get(ls, i)), "\n"),
    )
    added = {
        "text": F.when(F.col("drops").isNull(), text).otherwise(left),
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.size("drops"), F.lit(0)).cast("long"),
    }
    kept = [added[c].alias(c) if c in added else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*kept, *[v.alias(k) for k, v in added.items() if k not in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A null or empty text is one empty line; see dedup_lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {SPACE_SQL}), {UPPER_SQL}) AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, bad.key IS NOT NULL AND k.doc_id <> bad.last AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
