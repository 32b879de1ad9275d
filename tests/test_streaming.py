import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import minhash
from tidewatch.operators import dedup, facts as fx
from tidewatch.plans import trending
from tidewatch.streaming import jobs

START = dt.datetime(2024, 1, 1)
FACT = ("mention_id long, ticker string, article_id long, timestamp timestamp, source string, sentiment double,"
        " source_weight double, url string")


@pytest.fixture
def folder(spark, tmp_path):
    """Four snapshot files in arrival order, with repeats and some late rows."""
    rng = random.Random(1)
    path = str(tmp_path / "in")
    for part in range(4):
        rows = []
        for i in range(150):
            hours = part * 24 + rng.random() * 24 - (30 if rng.random() < 0.1 else 0)
            n = part * 150 + i
            rows.append((n, rng.choice(["A", "A", "B", "C"]), n, START + dt.timedelta(hours=hours), rng.choice(["gdelt", "stocktwits", "newsapi"]),
                         rng.choice([None, 0.5, -0.25]), 0.75, f"u{rng.randrange(200)}"))
        spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(path)
    return path


def finish(q):
    assert q.awaitTermination(300)


def test_hourly_counts_equal_the_batch(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    feed = jobs.stream_files(spark, folder, batch.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    finish(jobs.write_updates(jobs.stream_hourly(feed), out, str(tmp_path / "cp")))
    updates = spark.read.parquet(out)
    assert updates.select("batch").distinct().count() == 4
    got = jobs.latest_update(updates, ["ticker", "hour_bucket"], ["mentions"])
    want = fx.hourly_mentions(batch, START + dt.timedelta(days=4), 10_000).select("ticker", "hour_bucket", "mentions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_urls_once_over_all_batches(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    feed = jobs.stream_files(spark, folder, batch.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    finish(jobs.write_updates(jobs.stream_url_dedupe(feed), out, str(tmp_path / "cp"), "append"))
    urls = [r.url for r in spark.read.parquet(out).collect()]
    assert len(urls) == len(set(urls)) and set(urls) == {r.url for r in batch.select("url").distinct().collect()}


def test_very_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    for n, hours in enumerate((24 * 30, 24 * 24, 24 * 10)):
        row = [(n, "A", n, START + dt.timedelta(hours=hours), "gdelt", None, 0.75, "u")]
        spark.createDataFrame(row, FACT).coalesce(1).write.mode("append").parquet(path)
    feed = jobs.stream_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    finish(jobs.write_updates(jobs.stream_hourly(feed), out, str(tmp_path / "cp")))
    hours = {r.hour_bucket for r in spark.read.parquet(out).collect()}
    assert START + dt.timedelta(hours=24 * 24) in hours and START + dt.timedelta(hours=24 * 10) not in hours


def test_near_duplicates_over_batches(spark, tmp_path):
    rng = random.Random(2)
    roots = [[f"w{rng.randrange(300)}" for _ in range(50)] for _ in range(5)]
    rows = []
    for i in range(90):
        body = list(rng.choice(roots))
        for _ in range(rng.choice([0, 1, 2, 9])):
            body[rng.randrange(50)] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(body)))
    path = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part * 30:(part + 1) * 30], "id long, content string").coalesce(1).write.mode("append").parquet(path)
    feed = jobs.stream_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = str(tmp_path / "kept")
    finish(jobs.stream_near_dup(feed, out, str(tmp_path / "cp"), lambda: START, ["id"]))
    signed = spark.createDataFrame(rows, "id long, content string").withColumn("minhash_signature", minhash.signature("content"))
    want = {r.id for r in dedup.greedy_verdicts(signed, []).filter("kept").collect()}
    assert {r.id for r in spark.read.parquet(out).collect()} == want


def test_near_duplicate_batches_keep_no_second_copy_of_texts(spark, tmp_path, monkeypatch):
    path, shapes = str(tmp_path / "in"), []
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "g h i j k l")]
    spark.createDataFrame(rows, "id long, content string").coalesce(1).write.parquet(path)
    real = jobs.durable
    monkeypatch.setattr(jobs, "durable", lambda df: shapes.append(df.columns) or real(df))
    feed = jobs.stream_files(spark, path, spark.read.parquet(path).schema)
    out = str(tmp_path / "out")
    jobs.stream_near_dup(feed, out, str(tmp_path / "offsets"), lambda: dt.datetime(2024, 1, 1), []).awaitTermination()
    kept = spark.read.parquet(out)
    assert sorted((r["id"], r["content"]) for r in kept.select("id", "content").collect()) == [(1, "a b c d e f"), (3, None), (5, "g h i j k l")]
    assert kept.filter("size(bands) = 21 and size(minhash_signature) = 128").count() == 3
    assert shapes and not any("content" in s for s in shapes)



def test_board_equals_the_batch(spark, folder, tmp_path):
    tickers = spark.createDataFrame([("A", "Energy", "Alpha"), ("B", None, "Beta"), ("C", "Energy", "C")],
                                    "symbol string, sector string, company_name string")
    batch = spark.read.parquet(folder)
    feed = jobs.stream_files(spark, folder, batch.schema, files_per_trigger=2)
    facts, board = str(tmp_path / "facts"), str(tmp_path / "board")
    finish(jobs.stream_board(feed, tickers, facts, board, str(tmp_path / "cp")))
    as_of = batch.agg(F.max("timestamp")).first()[0]
    want = trending.trending(batch, tickers, as_of)
    from tidewatch.sources import store

    got = store.load_boards(spark, board).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # replaying a batch number replaces its rows
    store_rows = spark.read.parquet(facts).count()
    store.write_table(spark.read.parquet(facts).filter("batch = 0").drop("batch").checkpoint(), facts, 0)
    assert spark.read.parquet(facts).count() == store_rows


def test_sums_of_batches_give_the_same_board(spark, folder):
    """Whatever the time of the board, and with facts on both sides of every window's edge."""
    batch = spark.read.parquet(folder).withColumn("dt", F.to_date("timestamp"))
    sums = None
    for part in range(4):
        new = fx.hour_sums(batch.filter(F.col("mention_id") % 4 == part)).withColumn("dt", F.to_date("hour"))
        sums = new if sums is None else sums.unionByName(new)
    tickers = spark.createDataFrame([("A", "Energy", "Alpha"), ("B", None, "Beta"), ("C", "Energy", "C")],
                                    "symbol string, sector string, company_name string")
    for as_of in (START + dt.timedelta(hours=95, minutes=17, microseconds=5), START + dt.timedelta(hours=70), START + dt.timedelta(days=8, minutes=59)):
        want = sorted(map(tuple, fx.ticker_metrics(batch, as_of, 24).collect()))
        assert sorted(map(tuple, fx.metrics_from_sums(sums, batch, as_of, 24).collect())) == want
        got = trending.trending_from_sums(sums, batch, tickers, as_of)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trending.trending(batch, tickers, as_of).collect()))


def test_board_reads_facts_of_edge_hours_only(spark, folder, capfd):
    batch = spark.read.parquet(folder)
    sums = fx.hour_sums(batch).checkpoint()
    fx.metrics_from_sums(sums, batch, START + dt.timedelta(days=3, minutes=5), 24).explain("formatted")
    plan = capfd.readouterr().out
    assert plan.count("Scan parquet") == 2 and "PushedFilters: [Or(" in plan.replace("IsNotNull(timestamp), ", "")


def test_update_log_stays_small(spark, tmp_path):
    """Fifty micro-batches leave a snapshot and the changes since; values equal the batch."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, "ABC"[i % 3], i, START + dt.timedelta(minutes=7 * i), "gdelt", 0.5, 1.0, "u") for i in range(100)]
    for n in range(50):
        spark.createDataFrame(rows[2 * n:2 * n + 2], FACT).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    feed = jobs.stream_files(spark, path, batch.schema, files_per_trigger=1)
    keys = ["ticker", "hour_bucket"]
    finish(jobs.write_updates(jobs.stream_hourly(feed), out, str(tmp_path / "cp"), keys=keys))
    updates = spark.read.parquet(out)
    assert updates.select("batch").distinct().count() <= jobs.COMPACT_EVERY and len(updates.inputFiles()) <= 10 * jobs.COMPACT_EVERY
    want = fx.hourly_mentions(batch, START + dt.timedelta(days=4), 10_000).select("ticker", "hour_bucket", "mentions")
    hourly = jobs.latest_update(updates, keys, ["mentions"])
    assert sorted(map(tuple, hourly.collect())) == sorted(map(tuple, want.collect()))
    ends = F.explode(F.sequence(F.lit(1), F.lit(24)))
    slide = batch.select("ticker", F.date_trunc("hour", "timestamp").alias("h"), ends.alias("k")).groupBy(
        "ticker", F.timestamp_add("HOUR", F.col("k"), F.col("h")).alias("window_end")).count()
    assert sorted(map(tuple, jobs.rolled_up(hourly).collect())) == sorted(map(tuple, slide.collect()))


def test_sliding_windows_are_not_shuffled(spark):
    """hourly sums are shuffled by ticker, the 24 windows of each are not."""
    rows = [("A", dt.datetime(2024, 5, 1, h), n) for h, n in ((0, 1), (5, 2), (23, 4))] + [("B", dt.datetime(2024, 5, 1, 7), 8)]
    rolled = jobs.rolled_up(spark.createDataFrame(rows, "ticker string, hour_bucket timestamp, mentions long"))
    assert "hashpartitioning(ticker" in (plan := rolled._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "window_end" in line]
    got = {(r["ticker"], r["window_end"]): r["mentions"] for r in rolled.collect()}
    assert got[("A", dt.datetime(2024, 5, 2, 0))] == 7 and got[("A", dt.datetime(2024, 5, 2, 1))] == 6 and len(got) == 47 + 24
