"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base figures come from one pass over each text with array functions. Lines that
stand in too many documents of one host are its boilerplate: their hashes are
counted per host, and a document most of whose words stand in such lines is
rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, let, skew_join
from .lines import SPACE_SQL, UPPER_SQL, hashes, line_key, split_lines

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words_in(text: Column) -> Column:
    """The runs of characters other than ASCII white space, as an array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def repeat_words(words: Column) -> Column:
    """How many words of an array stand in 3-word windows that it holds twice or more.

    Windows are compared by 64-bit hash. A document without a repeated window isn't sorted.
    """
    zero = F.lit(0).cast("long")

    def covered(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j: F.get(s, j)["h"] == F.get(s, j + 1)["h"]  # noqa: E731
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce((j > 0) & same(j - 1), F.lit(False)) | F.coalesce(same(j), F.lit(False)))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        first = F.struct(F.lit(-3).alias("last"), zero.alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))  # noqa: E731
        return let(pairs, lambda s: F.aggregate(repeated(s), first, step, lambda a: a["n"]))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))  # noqa: E731
    return let(
        words,
        lambda w: F.when(F.size(w) < 4, zero).otherwise(let(windows(w), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), zero).otherwise(covered(t)))),
    )


def base_figures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    with_words = F.filter(split_lines(text), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    return let(
        words_in(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(with_words, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def boilerplate_words(rows: DataFrame, min_docs: int, max_share: float, most_docs: int) -> DataFrame:
    """(id, sum, gone): for rows (id, sum, host, text), the words in lines above their host's limit, where there are any."""
    lines = cut(
        rows.select("id", "sum", F.xxhash64("host").alias("host"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "sum", "host", "pos", "line", line_key(F.col("line")).alias("key"))
        .where("key <> ''")
        .select("id", "sum", "host", "pos", F.size(words_in(F.col("line"))).alias("words"), *hashes(F.col("key")))
    )
    # documents of a line by two partial counts, so that a line that all documents of a host have is no task's alone
    once = lines.where("id is not null").groupBy("host", "h1", "h2", "id").agg(F.lit(1).alias("one"))
    counted = cut(once.groupBy("host", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs))
    hosts = cut(rows.where("id is not null").groupBy(F.xxhash64("host").alias("host"), "id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs")))
    limit = F.least(max_share * F.col("host_docs"), F.lit(float(most_docs)))
    above = cut(skew_join(counted, hosts, ["host"], "host_docs").where(F.col("docs") > limit).select("host", "h1", "h2", "docs"))
    return (
        skew_join(lines, above, ["host", "h1", "h2"], "docs")
        .groupBy("id", "sum")
        .agg(F.aggregate(F.collect_set(F.struct("pos", "words")), F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("gone"))
    )


#: Documents of a host that a line stands in as boilerplate: so many at least, and more than this share of them or so many, whichever is less.
MIN_DOCS, MAX_SHARE, MOST_DOCS = 10, 0.01, 1000


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS, min_left: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Base figures of each row of docs, and whether to keep it.

    A line (normalised, with a word) is boilerplate of its host if it stands in at least min_docs
    of its documents, and in more than max_share of them or more than most_docs. Rows of one doc_id
    are one document, and a row without one is none, though it loses lines like any other. base_failed: fewer
    than min_words words, or over max_repeat of them in repeated windows. kept: not that, and at
    least min_left of its words stand in other lines. Returns doc_id, the figures, words_left,
    base_failed and kept. A null text has no words and fails; null hosts are one host. Repeated rows
    come back as often as they are given; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(host).cast("string").alias("host"), "text").withColumn("sum", F.xxhash64("host", "text"))
    gone = boilerplate_words(rows, min_docs, max_share, most_docs).select(F.col("id").alias("id_"), F.col("sum").alias("sum_"), "gone")
    figures = rows.select("id", "sum", base_figures(F.col("text")).alias("f")).select("id", "sum", "f.*")
    joined = figures.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sum") == F.col("sum_")), "left")
    n, left = F.col("n_words"), F.col("words_left")
    failed = (n < min_words) | (F.col("n_repeat_words") > max_repeat * n)
    return (
        joined.withColumn("words_left", n - F.coalesce("gone", F.lit(0)))
        .withColumn("base_failed", failed)
        .select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", (~failed & (left >= min_left * n)).alias("kept"))
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """A null or empty text has no words and fails; see quality_rules."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS) -> str:
    """The same as SQL over a view `documents`."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(ls) AS line FROM d),
lk AS (SELECT *, translate(trim(line, {SPACE_SQL}), {UPPER_SQL}) AS key FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lk WHERE key <> '' GROUP BY doc_id),
cnt AS (SELECT source, key, count(DISTINCT doc_id) AS docs FROM lk WHERE key <> '' GROUP BY source, key),
host AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
above AS (SELECT cnt.source, key FROM cnt JOIN host USING (source) WHERE docs >= {min_docs} AND docs > least({max_share} * host.n, {most_docs})),
gone AS (SELECT lk.doc_id, sum(len(regexp_extract_all(line, '[^ 	-]+'))) AS n FROM lk JOIN above USING (source, key) GROUP BY lk.doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS words_left
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 * n_words AS kept FROM f"""


ORACLES = {"op9_quality_rules": oracle()}
