"""Streaming jobs, run to completion over the supplied files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import session
from tidewatch.functions import minhash
from tidewatch.streaming import jobs
from tidewatch.operators import maintenance
from tidewatch.sources import store

from .boards import COUNTED, ranking
from .catalog import query
from .texts import EDGES, WALK
from .views import Views, ntz, pick, symbol, SOURCES, WEIGHTS_E2

TIMEOUT = 1800


def finish(q) -> None:
    """Wait for an available-now query; fail rather than wait for ever."""
    if not q.awaitTermination(TIMEOUT):
        q.stop()
        raise TimeoutError("the stream did not finish in time")


def mention_stream(v: Views, order: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Mention facts straight from the event files as they arrive, in three micro-batches at least."""
    e = F.col("event_id")
    units = F.greatest(F.lit(-10000), F.least(F.lit(10000), F.round((F.col("value") - 50) * 100).cast("bigint")))
    sentiment = F.when(e % 17 != 0, units / F.lit(10000.0))
    own = F.struct((e * 2).alias("mention_id"), symbol("user_id").alias("ticker"), sentiment.alias("sentiment"))
    other = F.struct((e * 2 + 1).alias("mention_id"), symbol((F.col("user_id") + 1) % (v.max_user + 1)).alias("ticker"),
                     (-sentiment).alias("sentiment"))
    rows = v.event_stream(order=order).select(
        e.alias("article_id"), F.col("ts").cast("timestamp").alias("timestamp"), pick(SOURCES, e % 12).alias("source"),
        (pick(WEIGHTS_E2, e % 12) / F.lit(100.0)).alias("source_weight"),
        F.concat(F.lit("https://example.com/"), symbol("user_id"), F.lit("/"), (e % 50).cast("string")).alias("url"),
        F.explode(F.when(e % 3 == 0, F.array(own, other)).otherwise(F.array(own))).alias("m"),
    )
    known = v.tickers.select(F.col("symbol").alias("ticker"))
    return rows.select("m.*", "article_id", "timestamp", "source", "source_weight", "url").join(known, "ticker", "left_semi")


def run_updates(v: Views, stream: DataFrame, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    out, checkpoint = session.scratch_path(v.spark, "stream"), session.scratch_path(v.spark, "offsets")
    finish(jobs.write_updates(stream, out, checkpoint, mode, keys))
    spec = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return store.load_table(v.spark, out, spec)


@query("stream_hourly", f"select ticker, date_trunc('hour',ts) hour_bucket, count(*) mentions from facts where {COUNTED} group by 1,2")
def stream_hourly(v: Views):
    updates = run_updates(v, jobs.stream_hourly(mention_stream(v)), keys=["ticker", "hour_bucket"])
    return jobs.latest_update(updates, ["ticker", "hour_bucket"], ["mentions"]).select("ticker", ntz("hour_bucket"), "mentions")


@query("stream_sliding", f"""select ticker, date_trunc('hour',ts)+to_hours(k) window_end, count(*) mentions
  from facts, range(1,25) r(k) where {COUNTED} group by 1,2""")
def stream_sliding(v: Views):
    updates = run_updates(v, jobs.stream_hourly(mention_stream(v)), keys=["ticker", "hour_bucket"])
    hourly = jobs.latest_update(updates, ["ticker", "hour_bucket"], ["mentions"])
    return jobs.rolled_up(hourly).select("ticker", ntz("window_end"), "mentions")


@query("stream_url_dedupe", "select url, min(id) first_id from articles group by url")
def stream_url_dedupe(v: Views):
    """The first arrival of each URL over all micro-batches, however long ago it was stored."""
    feed = mention_stream(v).select("url", "timestamp", F.col("article_id").alias("id"))
    out, checkpoint = session.scratch_path(v.spark, "urls"), session.scratch_path(v.spark, "offsets")
    finish(jobs.stream_new_urls(feed, out, checkpoint, ["timestamp", "id"]))
    return v.spark.read.parquet(out).select("url", F.col("id").alias("first_id"))


@query("stream_near_dup", EDGES + WALK + """
 select doc_id from documents where doc_id not in (select id from nodes) or list_contains((select kept from final), doc_id)""")
def stream_near_dup(v: Views):
    feed = v.event_stream("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    out, checkpoint = session.scratch_path(v.spark, "kept"), session.scratch_path(v.spark, "offsets")
    finish(jobs.stream_near_dup(feed, out, checkpoint, lambda: v.as_of, []))
    return v.spark.read.parquet(out).select(F.col("id").alias("doc_id"))


@query("stream_board", ranking(24) + "select * from boards")
def stream_board(v: Views):
    facts, board = session.scratch_path(v.spark, "facts"), session.scratch_path(v.spark, "board")
    finish(jobs.stream_board(mention_stream(v), v.tickers, facts, board, session.scratch_path(v.spark, "offsets")))
    return store.load_boards(v.spark, board)


@query("stream_files", "select event_type, count(*) n from events group by 1")
def stream_files(v: Views):
    counts = v.event_stream().groupBy("event_type").agg(F.count("*").alias("n"))
    return jobs.latest_update(run_updates(v, counts), ["event_type"], ["n"])


@query("stream_lateness", f""", arrived as (select ticker, ts from facts
  where {COUNTED} and article_id*3//(select max(event_id)+1 from events) >= 1)
  select ticker, date_trunc('hour',ts) hour_bucket, count(*) mentions from arrived
  where date_trunc('hour',ts)+to_hours(1) <= (select max(ts) from arrived) - to_days(7) group by 1,2""")
def stream_lateness(v: Views):
    """Final hourly counts where the oldest third of the events arrives last, after the watermark has passed it."""
    counts = jobs.stream_hourly(mention_stream(v, (1, 2, 0)))
    return run_updates(v, counts, "append").select("ticker", ntz("hour_bucket"), "mentions")


@query("stream_retention", """, kept as (select id from articles where "timestamp" >= (select t from latest) - to_days(7))
  select 'articles' as table_name, id from kept union all
  select 'mentions', id from mentions where article_id in (select id from kept)""")
def stream_retention(v: Views):
    """Retention applied in place to a stored feed."""
    path = session.scratch_path(v.spark, "retained")
    store.write_table(v.articles, f"{path}/articles", 0)
    store.write_table(v.mentions, f"{path}/mentions", 0)
    jobs.stream_retention(v.spark, path, v.as_of)
    a, m = v.spark.read.parquet(f"{path}/articles"), v.spark.read.parquet(f"{path}/mentions")
    return a.select(F.lit("articles").alias("table_name"), "id").unionByName(m.select(F.lit("mentions").alias("table_name"), "id"))
