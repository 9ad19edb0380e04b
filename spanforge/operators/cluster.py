"""Density clusters of dialogue events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_token, fixed
from ..schema import MEDIA
from .decisions import is_dialogue


def density_clusters(edl: DataFrame, window: float = 60.0, least: int = 3, span: float = 8.0, pad: float = 1.0) -> DataFrame:
    """Cuts over stretches where accepted mutes and cuts with dialogue behind them come densely.

    A cluster opens at an event with `least` events in the window from it on (itself included), takes all in
    that window, and goes on while the window up to the next event holds `least` of them. Whether an event
    opens one depends on where the last one closed, so counts are windows and the rest is a fold over one item's events.
    Columns: media_id, start, end, category, reason, n.
    """
    events = edl.where(F.col("accepted") & F.col("action").isin("mute", "cut") & is_dialogue(F.col("source")))
    # range frames over doubles take fractional bounds in SQL only; later peers are taken off the backward count, earlier ones off the forward
    by = "partition by media_id order by start"
    counted = (
        events.withColumn("_place", F.expr("row_number() over (partition by media_id, start order by seq)"))
        .withColumn("_peers", F.expr("count(*) over (partition by media_id, start)"))
        .withColumn("_ahead", F.expr(f"count(*) over ({by} range between current row and {float(window)}D following)") - F.col("_place") + 1)
        .withColumn("_behind", F.expr(f"count(*) over ({by} range between {float(window)}D preceding and current row)") - (F.col("_peers") - F.col("_place")))
    )
    item = F.struct("start", "seq", "end", first_token(F.col("category")).alias("category"), F.col("_ahead").alias("ahead"), F.col("_behind").alias("behind"))
    cluster = "struct<first:double,last:double,end:double,n:int,categories:array<string>>"
    zero = F.struct(F.array().cast(f"array<{cluster}>").alias("done"), F.lit(None).cast(cluster).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["open"]
        goes_on = cur.isNotNull() & ((x["start"] <= cur["first"] + window) | (x["behind"] >= least))
        opens = x["ahead"] >= least
        new = F.struct(x["start"].alias("first"), x["start"].alias("last"), x["end"].alias("end"), F.lit(1).alias("n"), F.array(x["category"]).alias("categories"))
        longer = F.struct(cur["first"].alias("first"), x["start"].alias("last"), F.greatest(cur["end"], x["end"]).alias("end"), (cur["n"] + 1).alias("n"), F.array_union(cur["categories"], F.array(x["category"])).alias("categories"))
        done = F.when(cur.isNotNull() & ~goes_on, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"])
        opened = F.when(goes_on, longer).when(opens, new).otherwise(F.lit(None).cast(cluster))
        return F.struct(done.alias("done"), opened.alias("open"))

    finish = lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    found = counted.groupBy(MEDIA).agg(F.sort_array(F.collect_list(item)).alias("_items")).select(MEDIA, F.explode(F.aggregate("_items", zero, step, finish)).alias("c"))
    length = F.col("c.end") - F.col("c.first")
    return found.where(length >= span).select(
        MEDIA,
        F.greatest(F.lit(0.0), F.col("c.first") - pad).alias("start"),
        (F.col("c.end") + pad).alias("end"),
        F.array_join(F.array_sort("c.categories"), "+").alias("category"),
        F.concat(F.lit("density: "), F.col("c.n").cast("string"), F.lit(" events in "), fixed(length, "0.0"), F.lit("s window")).alias("reason"),
        F.col("c.n").alias("n"),
    )
