"""Sentiment timelines and nearest-in-time look-ups.

Times are epoch milliseconds.  Neighbour look-ups work on fixed time slots:
inside a slot by a running window, across slots through one first/last row per
slot.  Rows are first reduced to one per millisecond, so a slot is bounded
whatever the number of articles of a symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vocab
from .filters import window_hours

# Window partition of a neighbour look-up: at most this many milliseconds.
SLOT_MS = 900_000


def epoch_ms(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(c.cast("timestamp"))


def sentiment_timeline(news: DataFrame, window: str) -> DataFrame:
    """Mean sentiment (missing as 0), count and earliest article per time bucket."""
    window_hours(window)
    size = vocab.TIMELINE_BUCKET_SECONDS[window] * 1000
    ms = epoch_ms("timestamp")
    bucket = ms - F.pmod(ms, F.lit(size))
    units = F.coalesce(scores.sentiment_units("sentiment"), F.lit(0))
    return news.groupBy("symbol", bucket.alias("ts")).agg(
        scores.exact_mean(units).alias("sentiment"),
        F.count("*").alias("mentions"),
        F.min_by("id", F.struct("timestamp", "id")).alias("article_id"),
    )


def neighbours(points: DataFrame, nodes: DataFrame, payload: list[str]) -> DataFrame:
    """For each (symbol, ts) point the last node at or before it and the first at or after it.

    `nodes` must hold one row per (symbol, ts).  Result columns: symbol, ts,
    `prev` and `next`, structs of (ts, payload...), NULL outside the nodes.
    """
    node = F.struct("ts", *payload)
    marked = nodes.select("symbol", "ts", node.alias("node"))
    slot = F.floor(F.col("ts") / F.lit(SLOT_MS)).cast("bigint")

    # one row per slot that has nodes; slots per symbol are bounded by elapsed time
    per_slot = marked.groupBy("symbol", slot.alias("slot")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    asked = points.select("symbol", slot.alias("slot")).distinct()
    grid = asked.join(per_slot, ["symbol", "slot"], "full")
    # both directions use a growing frame: one pass each, backwards for the later neighbour
    past = Window.partitionBy("symbol").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy("symbol").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    edges = grid.select(
        "symbol", "slot",
        F.last("hi", ignorenulls=True).over(past).alias("before"),
        F.last("lo", ignorenulls=True).over(future).alias("behind"),
    )

    rows = points.select("symbol", "ts", F.lit(None).cast(marked.schema["node"].dataType).alias("node"),
                         F.lit(True).alias("asked")).distinct()
    rows = rows.unionByName(marked.withColumn("asked", F.lit(False))).withColumn("slot", slot)
    inside = Window.partitionBy("symbol", "slot")
    upto, onward = inside.orderBy("ts"), inside.orderBy(F.desc("ts"))
    local = rows.select(
        "symbol", "slot", "ts", "asked",
        F.last("node", ignorenulls=True).over(upto.rangeBetween(Window.unboundedPreceding, 0)).alias("p"),
        F.last("node", ignorenulls=True).over(onward.rangeBetween(Window.unboundedPreceding, 0)).alias("n"),
    ).filter("asked")
    return local.join(edges, ["symbol", "slot"], "left").select(
        "symbol", "ts", F.coalesce("p", "before").alias("prev"), F.coalesce("n", "behind").alias("next")
    )


def nearest_article(points: DataFrame, articles: DataFrame) -> DataFrame:
    """Article nearest in time to each point of its symbol; ties go to the earlier one.

    `points` has (symbol, ts); `articles` has (symbol, id, timestamp).
    """
    nodes = articles.groupBy("symbol", epoch_ms("timestamp").alias("ts")).agg(F.min("id").alias("id"))
    near = neighbours(points, nodes, ["id"])
    back = F.col("ts") - F.col("prev.ts")
    ahead = F.col("next.ts") - F.col("ts")
    pick = F.when(F.col("prev").isNull(), F.col("next.id")).when(F.col("next").isNull(), F.col("prev.id")).otherwise(
        F.when(back <= ahead, F.col("prev.id")).otherwise(F.col("next.id"))
    )
    return near.select("symbol", "ts", pick.alias("article_id"))


def nearest_bucket(points: DataFrame, timeline: DataFrame) -> DataFrame:
    """Timeline bucket nearest to each point; the earlier one on ties."""
    near = neighbours(points, timeline, [])
    back = F.col("ts") - F.col("prev.ts")
    ahead = F.col("next.ts") - F.col("ts")
    pick = F.when(F.coalesce(back <= ahead, F.col("next").isNull()), F.col("prev.ts")).otherwise(F.col("next.ts"))
    return near.select("symbol", "ts", pick.alias("bucket_ts"))


def interpolate_timeline(points: DataFrame, timeline: DataFrame) -> DataFrame:
    """Linear interpolation of a timeline at arbitrary times, flat outside its ends."""
    near = neighbours(points, timeline, ["sentiment"])
    a, b = F.col("prev.sentiment"), F.col("next.sentiment")
    span = (F.col("next.ts") - F.col("prev.ts")).cast("double")
    share = (F.col("ts") - F.col("prev.ts")).cast("double") / span
    value = (
        F.when(F.col("prev").isNull(), b).when(F.col("next").isNull(), a).when(span == 0, a)
        .otherwise(a + share * (b - a))
    )
    return near.select("symbol", "ts", value.alias("sentiment"))
