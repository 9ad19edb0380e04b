"""Helpers shared by the corpus operators: checkpoints, Arrow maps, components.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows for one Arrow batch are further cut to this many bytes of text inside the workers.
CHUNK_BYTES = 8 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new temporary one on a local master where that is unset (tests). Elsewhere that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    set_dir = context._jsc.sc().getCheckpointDir()
    if set_dir.isEmpty():
        if not where and context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spanforge-"))
        set_dir = context._jsc.sc().getCheckpointDir()
    return where or set_dir.get()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later stages survive lost executors and don't recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, plain: bool = False) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, smaller than a checkpoint, and the table's path; remove() it when nothing reads it any more. plain: columns that are compressed or random already are left as they are."""
    path = scratch(df.sparkSession, what)
    options = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Shuffles and checkpoints that nothing refers to leave the disk when the driver collects its garbage, by itself every half hour: it is asked to do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, row_bytes: int, most: int = 16 << 20) -> DataFrame:
    """df (checkpointed) marked for broadcast if its rows, of about row_bytes each, fit in `most` bytes; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone. ASCII text, told by its length, takes the quick way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about `most` bytes of `column`; a longer single row is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty, and bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_arrow(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose workers find this package where the driver does, if they have that folder."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in [*paths, ROOT] if p])
    return df.mapInArrow(each, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, most_hot: int = 200, least: int = 10_000, fits: Column | None = None) -> DataFrame:
    """Inner join of left to right, where right has one row per key and `weight` is about how many rows left has of it.

    Keys with over 1 / most_hot of the total weight are broadcast, so their rows stay where they are;
    there can't be more than most_hot of them. The rest is shuffled. fits: a condition on right's rows that bounds the size of
    those that are broadcast, where they can be long; hot ones beyond it are shuffled, and split by adaptive execution. right is read several
    times: checkpoint it first.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    bar = max(least, total / most_hot)
    if total <= least:
        return left.join(right, keys)
    # left is read once: rows of hot keys have their match before the shuffle, and a salt that spreads them there
    values = F.struct(*[c for c in right.columns if c not in keys])
    is_hot = F.col(weight) > bar if fits is None else (F.col(weight) > bar) & fits
    hot = right.where(is_hot).select(*keys, values.alias("_hot"))
    cold = right.where(~is_hot).select(*keys, F.lit(0).alias("_salt"), values.alias("_cold"))
    spread = 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(1 << 20)).cast("int")
    tried = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(spread))
    met = tried.join(cold, [*keys, "_salt"], "left").withColumn("_of", F.coalesce("_hot", "_cold")).where(F.col("_of").isNotNull())
    return met.select(*keys, *[F.col(f"`{c}`") for c in left.columns if c not in keys], "_of.*")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a, b) longs, either way round, repeats and loops allowed. Returns
    (node, root) for every node that isn't the smallest of its component; root is
    the smallest node reachable. Each round is a groupBy-min and an equi-join on the
    node, so a hub is pre-aggregated and its join rows can be split by AQE. Each
    round's edges are checkpointed, and only two figures come to the driver.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = state(e)
    if last[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = state(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
