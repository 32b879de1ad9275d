import datetime as dt
import pathlib
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.operators import facts as fx, maintenance, models
from tidewatch.plans import ingest as ing
from tidewatch.plans import trending
from tidewatch.sources import store

DAY = dt.datetime(2024, 1, 10, 12, 0)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def confirmed_items(spark, n=6, start=0):
    rows = [(f"i{i}", "gdelt", f"t{i}", "c", DAY - dt.timedelta(days=i), f"http://u/{i}") for i in range(start, start + n)]
    df = spark.createDataFrame(rows, "id string, source string, title string, content string, timestamp timestamp, url string")
    m = F.array(F.struct(F.lit("A").alias("ticker"), F.lit(0.5).alias("sentiment"), F.lit(0.75).alias("source_weight"), F.lit("s").alias("summary")),
                F.struct(F.lit("ZZ").alias("ticker"), F.lit(0.1).alias("sentiment"), F.lit(0.75).alias("source_weight"), F.lit("s").alias("summary")))
    return df.withColumn("confirmed", m).withColumn("created_at", F.lit(DAY).cast("timestamp"))


@pytest.fixture
def tickers(spark):
    return spark.createDataFrame([("A", "Energy", "Alpha"), ("B", "Energy", "Beta")], "symbol string, sector string, company_name string")


def test_store_is_idempotent_and_checks_symbols(spark, tmp_path, tickers):
    path = str(tmp_path / "s")
    assert store.load_articles(spark, path).count() == 0
    for _ in range(2):
        store.write_feed(confirmed_items(spark), path, 1, tickers)
    store.write_feed(confirmed_items(spark, 2, 50), path, 2, tickers)
    a, m = store.load_articles(spark, path), store.load_mentions(spark, path)
    assert a.count() == 8 and a.select("id").distinct().count() == 8
    assert {r.ticker for r in m.select("ticker").collect()} == {"A"} and m.count() == 8
    assert fx.mention_facts(m, a).count() == 8


def test_retention_in_place_matches_the_batch_rule(spark, tmp_path, tickers):
    path = str(tmp_path / "s")
    store.write_feed(confirmed_items(spark, 12), path, 1, tickers)
    as_of = DAY + dt.timedelta(hours=1)
    kept, owned = maintenance.retain(store.load_articles(spark, path), store.load_mentions(spark, path), as_of)
    ids = {r.id for r in kept.collect()}
    assert len(ids) == 7 and owned.count() == 7
    for _ in range(2):  # a second run changes nothing
        maintenance.expire_store(spark, path, as_of)
        assert {r.id for r in store.load_articles(spark, path).collect()} == ids
        assert store.load_mentions(spark, path).count() == 7
    maintenance.expire_store(spark, path, as_of + dt.timedelta(days=2))
    assert store.load_articles(spark, path).count() == 5


def test_window_prunes_partitions_of_both_tables(spark, tmp_path, tickers):
    path = str(tmp_path / "s")
    store.write_feed(confirmed_items(spark, 12), path, 1, tickers)
    facts = fx.mention_facts(store.load_mentions(spark, path), store.load_articles(spark, path))
    plan = trending.rank_tickers(facts, tickers, DAY)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "dt#" in line]
    assert len(scans) >= 2 and all(">=" in s.split("PartitionFilters: [")[1].split("PushedFilters")[0] for s in scans)


def test_leaderboard(spark, tmp_path):
    path = str(tmp_path / "b")
    boards = spark.createDataFrame([("global", 1, "A"), ("Energy", 1, "A"), ("global", 2, "B")], "board string, rank int, symbol string")
    store.write_leaderboard(boards, path)
    store.write_leaderboard(boards.filter("board = 'global'"), path)
    assert [r.symbol for r in store.read_board(spark, path, "global").collect()] == ["A", "B"]
    assert [r.board for r in store.list_boards(store.load_boards(spark, path)).collect()] == ["global"]
    (tmp_path / "b" / "version=9").mkdir()  # a version that was never finished
    assert store.load_boards(spark, path).count() == 2
    store.write_leaderboard(boards, path)
    assert store.load_boards(spark, path).count() == 3 and not (tmp_path / "b" / "version=0").exists()


def test_tickers_from_csv_and_upsert(spark, tmp_path):
    (tmp_path / "t.csv").write_text("symbol,sector,company_name\nB,Energy,Beta\nA,,\n")
    base = store.load_tickers(spark, str(tmp_path / "t.csv"))
    assert [(r.symbol, r.sector) for r in base.collect()] == [("A", None), ("B", "Energy")]
    new = spark.createDataFrame([("B", "X", "x"), ("C", "X", "x"), ("C", "Y", "y")], "symbol string, sector string, company_name string")
    got = {r.symbol: r.sector for r in maintenance.upsert_tickers(base, new).collect()}
    assert got == {"A": None, "B": "Energy", "C": "X"}
    assert maintenance.upsert_tickers(maintenance.upsert_tickers(base, new), new).count() == 3


def test_weight_backfill(spark):
    articles = spark.createDataFrame([(1, "gdelt"), (2, "reddit"), (3, "odd")], "id long, source string")
    mentions = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5), (3, 2, 1.0), (4, 3, 1.0), (5, 9, 1.0)], "id long, article_id long, source_weight double")
    got = {r.id: r.source_weight for r in maintenance.backfill_weights(mentions, articles).collect()}
    assert got == {1: 0.75, 2: 0.5, 3: 0.2, 4: 1.0, 5: 1.0}
    audit = [(r.source, r.mention_count, r.new_weight) for r in maintenance.weight_audit(mentions, articles).collect()]
    assert audit == [("gdelt", 1, 0.75), ("odd", 1, 1.0), ("reddit", 1, 0.2)]


def test_backfills_rewrite_touched_dates_only(spark, tmp_path, tickers):
    path = str(tmp_path / "s")
    day = F.dayofmonth("timestamp")
    items = confirmed_items(spark, 4).withColumn("confirmed", F.transform("confirmed", lambda m: m.withField(
        "source_weight", F.when(day == 9, 1.0).otherwise(0.75))))
    ready = items.withColumn("embedding", F.when(day != 8, F.array(F.lit(1.0).cast("float")))).withColumn(
        "minhash_signature", F.when(day != 7, F.array(F.lit(1))))
    store.write_feed(ready, path, 1, tickers)

    def files(table):
        return {str(f.parent.parent.name): f.name for f in (tmp_path / "s" / table).glob("dt=*/batch=*/part-*")}

    for table, run, touched in (
        ("articles", lambda: maintenance.rewrite_minhash(spark, path), 7),
        ("articles", lambda: maintenance.rewrite_embeddings(spark, path, letters), 8),
        ("mentions", lambda: maintenance.rewrite_weights(spark, path), 9),
    ):
        before = files(table)
        assert [d.day for d in run()] == [touched]
        after = files(table)
        assert {d for d in before if before[d] != after[d]} == {f"dt=2024-01-{touched:02}"} and before.keys() == after.keys()
        assert run() == []
    articles, mentions = store.load_articles(spark, path), store.load_mentions(spark, path)
    assert articles.count() == 4 and mentions.count() == 4
    assert articles.filter("embedding is null or minhash_signature is null").count() == 0
    assert {r.source_weight for r in mentions.collect()} == {0.75}


def letters(texts):
    return np.array([[1.0 + t.count("a"), 1.0 + t.count("b")] for t in texts])


def feed(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, title string, content string, timestamp timestamp, url string,"
                                       " tickers array<string>, sentiment double")


def test_ingest(spark, tmp_path, tickers):
    path = str(tmp_path / "s")
    body = " ".join(f"w{i}" for i in range(60))
    known = spark.createDataFrame([("AAA", "Energy", "Alpha"), ("BBB", "Energy", "Beta")], "symbol string, sector string, company_name string")
    t = DAY
    first = feed(spark, [
        ("1", "gdelt", "AAA gain", body, t, "u1", [], None),
        ("2", "gdelt", "BBB copy of the text", body + " tail", t + dt.timedelta(minutes=1), "u2", [], None),   # near copy
        ("3", "gdelt", "no symbol here", "other words entirely", t, "u3", [], None),                           # no ticker
        ("4", "stocktwits", None, "short message about it", t, "u4", ["BBB"], -1.0),
        ("5", "alphavantage", "named", "BBB loss in the text", t, "u5", ["AAA", "ZZZ"], None),                 # names win
        ("6", "gdelt", "AAA again", "same address", t + dt.timedelta(minutes=9), "u1", [], None),              # known URL
        ("7", "finnhub_general", "AAA scan", "record growth for AAA", t, "u7", [], None),
        ("8", "gdelt", "AAA", "no address", t, None, [], None),
    ])
    ing.ingest(first, path, known, models.LexiconScorer(), letters, t, 1)
    ing.ingest(first, path, known, models.LexiconScorer(), letters, t, 1)  # replay
    a = {r.url: r for r in store.load_articles(spark, path).collect()}
    assert set(a) == {"u1", "u4", "u5", "u7"}
    assert all(len(r.minhash_signature) == 128 and len(r.embedding) == 2 for r in a.values())
    m = {(r.ticker, r.article_id): r for r in store.load_mentions(spark, path).collect()}
    assert m["BBB", a["u4"].id].sentiment == -1.0 and m["BBB", a["u4"].id].source_weight == 0.3
    assert m["AAA", a["u5"].id].source_weight == 1.0 and ("BBB", a["u5"].id) not in m
    assert m["AAA", a["u1"].id].sentiment == 1.0 and m["AAA", a["u7"].id].source_weight == 0.9

    second = feed(spark, [("9", "gdelt", "AAA later copy", body + " other tail", t, "u9", [], None),
                          ("10", "gdelt", "BBB fresh", "completely different story today", t, "u10", [], None)])
    later = t + dt.timedelta(hours=2)
    assert [r.url for r in ing.ingest(second, path, known, models.LexiconScorer(), letters, later, 2).collect()] == ["u10"]
    # after a day the stored signature no longer blocks
    third = feed(spark, [("11", "gdelt", "AAA much later copy", body + " third tail", t, "u11", [], None)])
    late = t + dt.timedelta(hours=30)
    assert [r.url for r in ing.ingest(third, path, known, models.LexiconScorer(), letters, late, 3).collect()] == ["u11"]
    assert store.load_articles(spark, path).count() == 6


def test_ingest_of_repeated_tickers_and_ties(spark, tmp_path):
    """A ticker named twice counts twice, as the item says; of records alike in URL, time and id the smaller text wins."""
    known = spark.createDataFrame([("AAA", "Energy", "Alpha")], "symbol string, sector string, company_name string")
    rows = [("1", "finnhub_general", "one", "record growth", DAY, "u1", ["AAA", "AAA"], None),
            ("2", "finnhub_insider", "b", "second text", DAY, "u2", ["AAA"], 0.5),
            ("2", "finnhub_insider", "a", "first text", DAY, "u2", ["AAA"], -0.5)]
    for n, order in enumerate((rows, rows[::-1])):
        got = {r.url: r for r in ing.ingest(feed(spark, order), str(tmp_path / str(n)), known, models.LexiconScorer(), letters, DAY, 0).collect()}
        assert [m.ticker for m in got["u1"].confirmed] == ["AAA", "AAA"] and got["u2"].sentiment == -0.5 and got["u2"].content == "first text"


def files_below(folder):
    return [f for f in folder.rglob("*") if f.is_file() and not f.name.startswith(".") and f.name != "_SUCCESS"]


def test_a_step_leaves_its_result_only(spark, tmp_path, monkeypatch):
    """what the steps of an ingest run keep on shared storage goes with them; the run leaves the store and its items."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    checkpoints, noted = [], session._note
    monkeypatch.setattr(session, "_note", lambda path: (checkpoints.append(path.removeprefix("file:")), noted(path))[1])
    known = spark.createDataFrame([("AAA", "Energy", "Alpha")], "symbol string, sector string, company_name string")
    rows = [(str(i), "gdelt", f"AAA {i}", " ".join(f"w{i % 7}x{j}" for j in range(30)), DAY + dt.timedelta(minutes=i), f"u{i}", [], None) for i in range(20)]
    ready = ing.ingest(feed(spark, rows), str(tmp_path / "s"), known, models.LexiconScorer(), letters, DAY, 0)
    assert {r.id for r in ready.collect()} == {str(i) for i in range(7)}
    left = {p for p in checkpoints if pathlib.Path(p).exists() and files_below(pathlib.Path(p))}
    assert len(checkpoints) > 10 and left == {pathlib.Path(f.removeprefix("file:")).parent.as_posix() for f in ready.inputFiles()}
    assert spark.conf.get(session.TIDY, None) is None or spark.conf.get(session.TIDY) == "false"


def test_kept_tables_leave_no_shuffle_files(spark, tmp_path):
    """a table on shared storage needs none of the shuffles that led to it."""
    ids = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return sum("shuffle" in f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(ids.getAllFiles()))

    for keep in (session.durable, session.stored):
        before = shuffles()
        kept = keep(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.max("id").alias("m")).join(spark.range(2000).withColumnRenamed("id", "m"), "m"))
        for _ in range(50):
            if shuffles() <= before:
                break
            time.sleep(0.1)
        assert shuffles() <= before and kept.count() == 10
