"""Range primitives per media item: islands, ordered folds, range existence, point lookup.

A media item's rows are ordered by (start, seq). One item is one window partition: its rows are as
many as one recording has, which is what bounds a task; items spread over the cluster. No
primitive is a nested loop: each is one shuffle by media_id and a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MEDIA, SEQ


def by_media(*order: Column | str) -> Window:
    return Window.partitionBy(MEDIA).orderBy(*(order or ("start", SEQ)))


def islands(df: DataFrame, gap: float = 0.0, name: str = "island") -> DataFrame:
    """Number the runs of rows that follow each other with at most `gap` between the farthest end so far and the next start."""
    before = by_media().rowsBetween(Window.unboundedPreceding, -1)
    upto = by_media().rowsBetween(Window.unboundedPreceding, 0)
    reach = df.withColumn("_reach", F.max("end").over(before))
    cut = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0)
    return reach.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(upto)).drop("_reach", "_cut")


def joined_once(values: Column, separator: str, trim: str | None = None) -> Column:
    """Strings of an ordered array joined, each only if it isn't empty and the text so far doesn't contain it; `trim`: characters stripped after each joining."""

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat(acc, F.lit(separator), x)
        return F.when(acc.isNull(), x).when(F.contains(acc, x), acc).otherwise(longer if trim is None else F.btrim(longer, F.lit(trim)))

    return F.aggregate(values, F.lit(None).cast("string"), step)


def ordered_rows(*fields: str) -> Column:
    """All rows of a group as an array of structs in (start, seq) order; an aggregate for one island or one media item."""
    return F.sort_array(F.collect_list(F.struct("start", SEQ, *[f for f in fields if f not in ("start", SEQ)])))


def range_exists(probe: DataFrame, build: DataFrame, radius: float = 0.0, strict: bool = False, name: str = "near") -> DataFrame:
    """probe with a flag: whether its item has a build row with b.start - radius <= p.end and b.end + radius >= p.start (< and > if strict).

    Both sides are one ordered stream keyed by b.start - radius and p.end; the farthest b.end + radius so
    far tells it. Linear after one sort, where a theta join is quadratic.
    """
    builds = build.select(MEDIA, (F.col("start") - radius).alias("_key"), (F.col("end") + radius).alias("_end"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).alias("_row"))
    rows = F.struct(*[F.col(f"`{c}`") for c in probe.columns])
    probes = probe.select(MEDIA, F.col("end").alias("_key"), F.lit(None).cast("double").alias("_end"), F.lit(0 if strict else 1).alias("_side"), rows.alias("_row"))
    both = builds.withColumn("_row", F.col("_row").cast(probes.schema["_row"].dataType)).unionByName(probes)
    return _reached(both, strict, name)


def _reached(events: DataFrame, strict: bool, name: str) -> DataFrame:
    so_far = Window.partitionBy(MEDIA).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    reach = events.withColumn("_reach", F.max("_end").over(so_far)).where(F.col("_row").isNotNull())
    start = F.col("_row.start")
    return reach.select("_row.*", F.coalesce(F.col("_reach") > start if strict else F.col("_reach") >= start, F.lit(False)).alias(name))


def range_exists_within(df: DataFrame, is_build: Column, radius: float = 0.0, name: str = "near") -> DataFrame:
    """range_exists of df against those of its own rows for which is_build holds; df is read once."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    probe = F.struct(F.col("end").alias("_key"), F.lit(None).cast("double").alias("_end"), F.lit(1).alias("_side"))
    build = F.struct((F.col("start") - radius).alias("_key"), (F.col("end") + radius).alias("_end"), F.lit(0).alias("_side"))
    events = df.select(MEDIA, row.alias("_row"), F.explode(F.array_compact(F.array(probe, F.when(is_build, build)))).alias("_e")).select(MEDIA, "_e.*", F.when(F.col("_e._side") == 1, F.col("_row")).alias("_row"))
    return _reached(events, False, name)


def stab(points: DataFrame, at: str, intervals: DataFrame, name: str = "hit") -> DataFrame:
    """points with the interval (start, end, and whatever else it has) that holds `at`, start <= at < end, or null.

    Intervals of an item don't overlap (shots, merged ranges): the last one that starts at or before the point decides.
    """
    fields = F.struct(*[F.col(f"`{c}`") for c in intervals.columns if c != MEDIA])
    left = intervals.select(MEDIA, F.col("start").alias("_key"), F.lit(0).alias("_side"), fields.alias("_hit"), F.lit(None).alias("_row"))
    rows = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    right = points.select(MEDIA, F.col(at).alias("_key"), F.lit(1).alias("_side"), F.lit(None).alias("_hit"), rows.alias("_row"))
    left = left.withColumn("_row", F.col("_row").cast(right.schema["_row"].dataType))
    right = right.withColumn("_hit", F.col("_hit").cast(left.schema["_hit"].dataType))
    so_far = Window.partitionBy(MEDIA).orderBy("_key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = left.unionByName(right).withColumn("_hit", F.last("_hit", ignorenulls=True).over(so_far)).where(F.col("_row").isNotNull())
    return last.select("_row.*", F.when(F.col("_key") < F.col("_hit.end"), F.col("_hit")).alias(name))


def first_holding(points: DataFrame, at: str, intervals: DataFrame, name: str = "hit") -> DataFrame:
    """points with the first interval, by (start, end), that holds `at`, both ends included, or null; intervals may overlap.

    Only those that end later than all before them can be the first: both their ends rise, so that the first of them to
    end at or after the point decides, found in one ordered stream.
    """
    before = Window.partitionBy(MEDIA).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rising = intervals.select(MEDIA, "start", "end").withColumn("_reach", F.max("end").over(before)).where("_reach is null or end > _reach")
    left = rising.select(MEDIA, F.col("end").alias("_key"), F.lit(1).alias("_side"), F.struct("start", "end").alias("_hit"))
    rows = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    right = points.select(MEDIA, F.col(at).alias("_key"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_hit"].dataType).alias("_hit"), rows.alias("_row"))
    both = left.withColumn("_row", F.lit(None).cast(right.schema["_row"].dataType)).unionByName(right)
    from_here = Window.partitionBy(MEDIA).orderBy(F.desc("_key"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(from_here)).where(F.col("_row").isNotNull())
    return met.select("_row.*", F.when(F.col("_hit.start") <= F.col("_key"), F.col("_hit")).alias(name))


def overlaps(rows: DataFrame, others: DataFrame, start: str, end: str, width: float = 64.0) -> DataFrame:
    """Pairs of rows [start, end] and others (start, end) of one item that overlap, touching ones not.

    Both are spread over the stretches of `width` seconds that they reach into, and meet in the first that they have in common:
    work follows the pairs that are near each other, not all pairs of an item.
    """
    slot = lambda c: F.floor(F.col(c) / width)
    left = rows.withColumn("_from", slot(start)).withColumn("_slot", F.explode(F.sequence("_from", F.greatest("_from", slot(end)))))
    right = others.withColumn("_from2", slot("start")).withColumn("_slot", F.explode(F.sequence("_from2", F.greatest("_from2", slot("end")))))
    met = left.join(right, [MEDIA, "_slot"]).where((F.col("_slot") == F.greatest("_from", "_from2")) & (F.col("start") < F.col(end)) & (F.col("end") > F.col(start)))
    return met.drop("_slot", "_from", "_from2")


def merged(ranges: DataFrame) -> DataFrame:
    """Union of overlapping or touching ranges: (media_id, start, end). Needs no order of its own."""
    keyed = ranges.select(MEDIA, "start", "end", F.col("end").alias(SEQ))
    return islands(keyed).groupBy(MEDIA, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
