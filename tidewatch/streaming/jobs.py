"""Streaming jobs.

Event time is the publication time and late data counts for seven days.
Windowed counts and URL removal are plain streaming queries; jobs that need
the whole store run per micro-batch and are safe to replay, because a batch
number always overwrites its own output.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import minhash, times, vocab
from ..operators import dedup, facts as fx, maintenance
from ..operators.filters import exclude_sources
from ..plans import trending
from ..session import durable
from ..sources import store

LATENESS = "7 days"
# A table of updates is rewritten as its current values after so many micro-batches.
COMPACT_EVERY = 10


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet snapshots as they arrive in a folder; a single file counts as one snapshot."""
    reader = spark.readStream.schema(schema)
    fs, jpath = store.file_system(spark, path)
    if fs.exists(jpath) and fs.getFileStatus(jpath).isFile():
        reader = reader.option("pathGlobFilter", jpath.getName())
        path = jpath.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text snapshots (GKG rows, JSON documents) as they arrive in a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def with_lateness(feed: DataFrame, delay: str = LATENESS, column: str = "timestamp") -> DataFrame:
    """Event-time column as TIMESTAMP with a watermark."""
    return feed.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_hourly(feed: DataFrame) -> DataFrame:
    """Counted mentions per ticker and clock hour."""
    return (
        exclude_sources(with_lateness(feed))
        .groupBy(F.window("timestamp", "1 hour"), "ticker").agg(F.count("*").alias("mentions"))
        .select("ticker", F.col("window.start").alias("hour_bucket"), "mentions")
    )


def stream_sliding(feed: DataFrame, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counted mentions per ticker over sliding windows, each mention in all of its windows; see rolled_up for whole hours."""
    return (
        exclude_sources(with_lateness(feed))
        .groupBy(F.window("timestamp", size, slide), "ticker").agg(F.count("*").alias("mentions"))
        .select("ticker", F.col("window.end").alias("window_end"), "mentions")
    )


def rolled_up(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Counts over windows of whole hours, one ending each hour, from the counts of stream_hourly.

    Only the sums per ticker and hour are spread over the windows that hold
    them, so no mention is copied.  They are shuffled before they are spread: all
    windows of a ticker are summed where its hours arrive, one row an hour.
    """
    hourly = hourly.repartition("ticker")
    ends = F.transform(F.sequence(F.lit(1), F.lit(hours)), lambda k: F.timestamp_add("HOUR", k, F.col("hour_bucket")))
    return hourly.select("ticker", F.explode(ends).alias("window_end"), "mentions").groupBy("ticker", "window_end").agg(
        F.sum("mentions").alias("mentions"))


def stream_url_dedupe(feed: DataFrame) -> DataFrame:
    """First arrival of each URL within the lateness; see stream_new_urls for the rule over all time."""
    return with_lateness(feed).dropDuplicatesWithinWatermark(["url"])


def stream_new_urls(feed: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Store the first arrival of each URL, exactly, over all micro-batches and restarts.

    Each batch is compared with the stored URLs, which only rows that share a
    URL with it leave their files for; no state is kept beside the store.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spec = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        stored = store.load_table(batch.sparkSession, path, spec).filter(F.col("batch") < batch_id)
        (
            dedup.drop_known_urls(batch, stored, order).withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        )

    return feed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_update(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Current value per key of a table written by `write_updates`."""
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("_v")
    ).select(*keys, "_v.*")


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  keys: list[str] | None = None, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Write every micro-batch to its own partition; a replay overwrites it.

    With `keys`, each `every`-th batch also takes in the current value per key
    of all earlier partitions, which then go: a snapshot and the changes since.
    latest_update reads both alike.  A replayed snapshot includes what its first
    attempt wrote, so nothing is lost if the attempt ended between the two.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        compact = keys and batch_id and batch_id % every == 0
        if compact:
            before = store.load_table(spark, path, rows.schema)
            values = [c for c in batch.columns if c not in keys]
            merged = latest_update(before.unionByName(rows), keys, values)
            rows = durable(merged.select(*batch.columns).withColumn("batch", F.lit(batch_id).cast("bigint")))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if compact:
            store.drop_partitions(spark, path, "batch", lambda name: int(name) < batch_id)

    return (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_near_dup(feed: DataFrame, path: str, checkpoint: str, arrived: Callable[[], dt.datetime],
                    order: list[str], id_col: str = "id", text_col: str = "content") -> StreamingQuery:
    """Store the items of each micro-batch that copy nothing stored in the last day nor each other.

    `arrived` gives the ingestion time of a batch; a replayed batch keeps the
    time of its first attempt.  The decision is the batch rule: earlier kept
    items win, exactly.  The store is laid out by ingestion day, so a batch
    reads two days of it, however old the store is, and it keeps the band hashes
    of every signature, which later batches join without hashing them again.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # texts stay where they are until the decision: what is kept beside them is keyed by id and text
        text_hash = F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_text")
        keys = [F.col(c) for c in dict.fromkeys([id_col, *order])]
        signed = durable(batch.select(*keys, text_hash, minhash.signature(text_col).alias("minhash_signature")))
        signed = signed.withColumn("bands", minhash.band_hashes(F.col("minhash_signature"), vocab.NEAR_DUP_THRESHOLD))
        spec = T.StructType([
            *batch.schema.fields, *signed.select("minhash_signature", "bands").schema.fields, T.StructField("created_at", T.TimestampType()),
            T.StructField("day", T.DateType()), T.StructField("batch", T.LongType()),
        ])
        table = store.load_table(spark, path, spec)
        before = times.latest_timestamp(table.filter(F.col("batch") == batch_id), "created_at")
        now = before or arrived()
        first_day = (times.utc(now) - dt.timedelta(hours=vocab.NEAR_DUP_HOURS)).date()
        stored = table.filter((F.col("batch") < batch_id) & (F.col("day") >= F.lit(first_day)))
        recent = dedup.recent_signatures(stored, now)
        kept = dedup.drop_near_duplicates(
            signed, None if recent.isEmpty() else recent, order, id_col=id_col, bands_col="bands")
        kept = kept.select(F.col(id_col).alias("_id"), "_text", "minhash_signature", "bands").dropDuplicates(["_id", "_text"])
        texts = batch.withColumn("_key", text_hash)
        texts = texts.join(kept, (texts[id_col] == kept["_id"]) & (texts["_key"] == kept["_text"])).drop("_id", "_text", "_key")
        stamped = texts.withColumn("created_at", times.literal_like(stored, "created_at", now))
        (
            stamped.withColumn("day", F.to_date("created_at")).withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        )

    return feed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_board(feed: DataFrame, tickers: DataFrame, store_path: str, board_path: str, checkpoint: str,
                 trigger: dict | None = None, now: Callable[[], dt.datetime] | None = None) -> StreamingQuery:
    """Add each micro-batch of mention facts to the store and rewrite the boards.

    Beside the facts the store keeps sums per ticker and hour, which a batch
    adds to.  Boards are dated by `now`, or by the newest stored publication
    time, and read the sums of their seven days; of the facts they read the
    hours only in which a window begins.  Sums that no window can reach go.
    Pass `trigger={"processingTime": "1 minute"}` for the minute refresh.
    """
    sums_path = f"{store_path.rstrip('/')}-hours"

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = durable(batch.withColumn("dt", F.to_date("timestamp")))
        store.write_table(dated, store_path, batch_id)
        new = fx.hour_sums(dated).withColumn("dt", F.to_date("hour"))
        store.write_table(new, sums_path, batch_id)
        numbered = T.StructField("batch", T.LongType())
        sums = store.load_table(spark, sums_path, T.StructType([*new.schema.fields, numbered]))
        as_of = now() if now else times.latest_timestamp(sums, "latest")
        if as_of is not None:
            facts = store.load_table(spark, store_path, T.StructType([*dated.schema.fields, numbered]))
            store.write_leaderboard(trending.trending_from_sums(sums, facts, tickers, as_of), board_path)
            first = (times.utc(as_of) - dt.timedelta(hours=vocab.BASELINE_HOURS + 24)).date().isoformat()
            store.drop_partitions(spark, sums_path, "dt", lambda name: name < first)

    return (
        feed.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_ingest(feed: DataFrame, checkpoint: str, job: Callable[[DataFrame, int], object]) -> StreamingQuery:
    """Run the ingest job on every micro-batch of normalised items."""

    def run(batch: DataFrame, batch_id: int) -> None:
        job(batch, batch_id)

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_retention(spark: SparkSession, store_path: str, as_of: dt.datetime) -> None:
    """The daily clean-up of a streaming store."""
    maintenance.expire_store(spark, store_path, as_of)
