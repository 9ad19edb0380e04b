"""The general tables as timelines: the same definitions for Spark and, as SQL, for the queries' checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import lexicon
from ..schema import DECISION_COLUMNS, MEDIA

#: A day of each item: a month of events, thirty times as fast.
DURATION = 86_400.0
SHOT_SECONDS, SHOTS = 600.0, 144
EXPLICIT = ("view", "signup", "click")
VOCABULARY = {"profanity": [r"\bthis\b", r"\bdie\b", {"pattern": r"\bwith\b", "strength": "weak"}], "drugs": [r"\bque\b", {"pattern": r"\band\b", "strength": "weak"}], "sex": [{"pattern": r"\ble\b", "strength": "weak"}, {"pattern": r"\bund\b", "strength": "weak"}], "other": [r"\bles\b"]}
#: `other` has no action, and is muted.
ACTIONS = {"profanity": "mute", "drugs": "mute", "sex": "cut", "violence": "keep"}
KEEPING = {**ACTIONS, "drugs": "keep"}
REPLACEMENTS = {"the": "a", "with": "by", "de la": "du", "and": "or", "que": "qui", "und": "oder", "or": "and"}

_BY_TYPE = {"click": ("subtitle", "profanity", "mute"), "error": ("whisper-word", "drugs", "mute"), "purchase": ("audio", "sex", "cut"), "view": ("vlm", "nudity", "cut"), "signup": ("visual-shot", "violence", "cut")}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _case(i: int) -> Column:
    case = F.lit(None).cast("string")
    for kind, values in _BY_TYPE.items():
        case = F.when(F.col("event_type") == kind, values[i]).otherwise(case)
    return case


def start_of(ts: str) -> Column:
    """Thirtieths of the seconds since 2024-01-01."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / F.lit(3e7)


def edl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions; each user is a media item."""
    e = read(spark, sf_dir, "events").withColumn("start", start_of("ts"))
    said = F.concat(F.lit("w"), (F.col("event_id") % 13).cast("string"))
    return e.select(
        F.col("user_id").alias(MEDIA),
        F.col("event_id").alias("seq"),
        "start",
        (F.col("start") + F.col("value") * 20.0).alias("end"),
        _case(2).alias("action"),
        _case(1).alias("category"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("matched: "), said, F.lit(", "), F.col("event_type")))
        .when(F.col("event_type") == "error", F.concat(F.lit("weak: "), said))
        .otherwise(F.concat("event_type", F.lit(" "), (F.col("event_id") % 3).cast("string")))
        .alias("reason"),
        F.when(F.col("event_type").isin("click", "error"), F.concat(F.lit("said "), said)).otherwise("").alias("text_before"),
        F.lit("").alias("text_after"),
        _case(0).alias("source"),
        (F.col("event_id") % 7 != 0).alias("accepted"),
    ).select(DECISION_COLUMNS)


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias(MEDIA), F.col("turn").cast("int").alias("idx"), (F.col("turn") * 12.0).alias("start"), (F.col("turn") * 12.0 + 8.0).alias("end"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("k", "text"))
    t = F.col("turn") * 12.0 + F.lit(0.04) * (F.col("k") + 1)
    return c.select(F.col("conv_id").alias(MEDIA), (F.col("turn") * 100_000 + F.col("k")).alias("pos"), t.alias("start"), (t + 0.03).alias("end"), "text", F.lit(1.0).alias("probability"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of equal length, but that each ninth is a gap."""
    i = F.col("shot_idx")
    rows = media(spark, sf_dir).select(MEDIA, F.explode(F.sequence(F.lit(0), F.lit(SHOTS - 1))).alias("shot_idx")).where(i % 9 != 8)
    return rows.select(MEDIA, "shot_idx", (i * SHOT_SECONDS).alias("start"), ((i + 1) * SHOT_SECONDS).alias("end"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias(MEDIA), F.lit(DURATION).alias("duration"), F.concat(F.lit("/m/"), "user_id", F.lit(".mkv")).alias("video_path"), F.lit("").alias("subtitle_path"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each event, numbered within its item; one detection each."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("m", F.col("user_id"))
    n = F.row_number().over(Window.partitionBy("m").orderBy("ts", "event_id")) - 1
    return e.select(F.col("m").alias(MEDIA), n.cast("double").alias("t"), start_of("ts").alias("at"), F.array(F.struct(F.col("event_type").alias("class"), (F.col("value") / 500).alias("score"))).alias("detections"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of several shapes, by event; some reasons are long, some categories null or not given."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("true", "false", '"true"', "1", "null")]), (k % 5 + 1).cast("int"))
    sure = F.element_at(F.array(*[F.lit(x) for x in ("0.9", '"0.8"', "0.3", "true", '"high"', "null")]), (k % 6 + 1).cast("int"))
    long = F.when(k % 7 == 0, F.repeat(F.lit("x"), 200)).otherwise("")
    category = F.when(k % 13 == 5, "null").otherwise(F.concat(F.lit('"'), _case(1), F.lit('"')))
    given = F.when(k % 13 == 6, "").otherwise(F.concat(F.lit(', "category": '), category))
    body = F.concat(F.lit('{"intimate": '), flag, F.lit(', "explicit": '), F.when(k % 3 == 0, "true").otherwise("false"), F.lit(', "should_cut": '), flag, F.lit(', "confidence": '), sure, given, F.lit(', "description": "d'), (k % 11).cast("string"), long, F.lit('", "reasoning": "r'), (k % 11).cast("string"), long, F.lit('"}'))
    raw = F.when(k % 17 == 0, "no json here").when(k % 2 == 0, F.concat(F.lit("Sure:\n"), body, F.lit("\nthere"))).otherwise(body)
    start = start_of("ts")
    return e.select(F.col("user_id").alias(MEDIA), k.alias("seq"), start.alias("start"), (start + 5.0).alias("end"), raw.alias("raw"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, start = read(spark, sf_dir, "events"), start_of("ts")
    score = lambda name, x: F.struct(F.lit(name).alias("label"), x.alias("score"))
    scores = F.array(score("Moan", F.col("value") / 100), score("Gunshot", F.lit(1.0) - F.col("value") / 100), score("Speech", F.lit(0.99)), score("Scream", F.col("value") / 100))
    return e.select(F.col("user_id").alias(MEDIA), F.col("event_id").alias("seq"), start.alias("start"), (start + F.col("value") / 10).alias("end"), scores.alias("scores"))


AUDIO_LABELS = {"Moan": "sex", "Gunshot": "violence", "Scream": "violence"}


def vocabulary():
    return lexicon(VOCABULARY)


_SQL_BY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {{{k}}}" for k in _BY_TYPE) + " END"


def _sql_case(i: int) -> str:
    return _SQL_BY.format(**{k: f"'{v[i]}'" for k, v in _BY_TYPE.items()})


SQL = {
    "edl": f"""edl AS (SELECT user_id::BIGINT AS media_id, event_id::BIGINT AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3e7::DOUBLE AS s,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3e7::DOUBLE + value * 20.0::DOUBLE AS e, {_sql_case(2)} AS action, {_sql_case(1)} AS category,
  CASE event_type WHEN 'click' THEN 'matched: w' || (event_id % 13) || ', click' WHEN 'error' THEN 'weak: w' || (event_id % 13) ELSE event_type || ' ' || (event_id % 3) END AS reason,
  CASE WHEN event_type IN ('click', 'error') THEN 'said w' || (event_id % 13) ELSE '' END AS text_before, '' AS text_after, {_sql_case(0)} AS source, event_id % 7 <> 0 AS accepted FROM events)""",
    "subs": "subs AS (SELECT conv_id AS media_id, turn::INT AS idx, turn * 12.0::DOUBLE AS s, turn * 12.0::DOUBLE + 8.0::DOUBLE AS e, text FROM conversations)",
    "words": r"""w0 AS (SELECT conv_id, turn, string_split_regex(trim(text), '\s+') AS ws FROM conversations),
words AS (SELECT conv_id AS media_id, turn * 100000 + k - 1 AS pos, turn * 12.0::DOUBLE + 0.04::DOUBLE * k AS s, turn * 12.0::DOUBLE + 0.04::DOUBLE * k + 0.03::DOUBLE AS e, ws[k] AS text
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w0))""",
    "items": "items AS (SELECT DISTINCT user_id::BIGINT AS media_id FROM events)",
    "shots": f"""shots AS (SELECT media_id, i::INT AS shot_idx, i * {SHOT_SECONDS}::DOUBLE AS s, (i + 1) * {SHOT_SECONDS}::DOUBLE AS e
  FROM (SELECT DISTINCT user_id::BIGINT AS media_id FROM events), range({SHOTS}) t(i) WHERE i % 9 <> 8)""",
    "frames": """frames AS (SELECT user_id::BIGINT AS media_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS t,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3e7::DOUBLE AS at, event_type AS cls, value / 500 AS score, value / 500 >= 0.1 AND event_type IN ('view', 'signup', 'click') AS hit FROM events)""",
    "answers": f"""answers AS (SELECT user_id::BIGINT AS media_id, event_id AS k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3e7::DOUBLE AS s, CASE event_id % 13 WHEN 5 THEN 'None' WHEN 6 THEN 'multi' ELSE {_sql_case(1)} END AS category, (event_id % 11) || CASE WHEN event_id % 7 = 0 THEN repeat('x', 200) ELSE '' END AS why,
  event_id % 17 <> 0 AS parses, event_id % 5 AS flag, CASE event_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 WHEN 3 THEN 1.0 ELSE 0.0 END AS conf FROM events)""",
}


def sql(*names: str) -> str:
    return ",\n".join(SQL[n] for n in names)
