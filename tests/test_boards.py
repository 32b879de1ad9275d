import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import facts as fx, topk
from tidewatch.plans import ticker, trending

AS_OF = dt.datetime(2024, 1, 8, 12, 0)


@pytest.fixture
def tables(spark):
    def at(hours):
        return AS_OF - dt.timedelta(hours=hours)

    rows = []
    # NVDA: one mention in each of ten earlier hours, then 30 in the last hour
    rows += [("NVDA", at(h), "gdelt", 0.5, 0.75) for h in range(5, 15)]
    rows += [("NVDA", at(0.5), "polygon", 0.5, 0.9)] * 30
    # GE: one bucket only, so no deviation; social sentiment counts, social mentions do not
    rows += [("GE", at(2), "newsapi", None, 0.8), ("GE", at(2), "stocktwits", 1.0, 0.3), ("GE", at(3), "stocktwits", -1.0, 0.3)]
    rows += [("XX", at(1.5), "newsapi", 0.1, 0.8)]            # not in the dimension
    rows += [("OLD", at(200), "newsapi", 0.1, 0.8), ("SOC", at(1), "stocktwits", 1.0, 0.3)]
    rows += [("FUT", AS_OF + dt.timedelta(hours=5), "gdelt", -0.2, 0.75)]  # dated ahead: in every window
    facts = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "article_id long, ticker string, timestamp timestamp_ntz, source string, sentiment double, source_weight double")
    facts = facts.withColumn("mention_id", F.col("article_id")).withColumn("title", F.concat("ticker", F.lit(" - Wire"))).withColumn("url", F.lit("u"))
    tickers = spark.createDataFrame(
        [("NVDA", "Technology", "Nvidia"), ("GE", None, None), ("OLD", "Energy", "Old"), ("SOC", "Energy", "Soc"), ("FUT", "Energy", "Fut")],
        "symbol string, sector string, company_name string")
    return facts, tickers


def test_ranking(tables):
    facts, tickers = tables
    got = {r.symbol: r for r in trending.rank_tickers(facts, tickers, AS_OF).collect()}
    assert set(got) == {"NVDA", "GE", "FUT"}
    nvda = got["NVDA"]
    mu, n = 40 / 11, 11
    sigma = ((10 * (1 - mu) ** 2 + (30 - mu) ** 2) / (n - 1)) ** 0.5
    z = (30 - mu) / sigma
    assert nvda.z_score == pytest.approx(z, abs=1e-4) and nvda.spike
    assert nvda.score == pytest.approx((2 * z + 0.3 * 40 + 2 * 0.5) * 1.3, abs=1e-3)
    ge = got["GE"]
    assert (ge.mentions_24h, ge.z_score, ge.sentiment, ge.sector, ge.company_name) == (1, 0.0, 0.0, "Unknown", "")
    assert got["FUT"].mentions_1h == 1


def test_as_of_may_carry_a_zone(tables):
    facts, tickers = tables
    facts = facts.withColumn("dt", F.to_date("timestamp"))
    zoned = AS_OF.replace(tzinfo=dt.timezone.utc).astimezone(dt.timezone(dt.timedelta(hours=13)))
    assert trending.rank_tickers(facts, tickers, zoned).exceptAll(trending.rank_tickers(facts, tickers, AS_OF)).count() == 0
    assert fx.mentions_last(facts, zoned, 24).count() == fx.mentions_last(facts, AS_OF, 24).count() > 0


def test_boards_are_sorted_and_capped(spark):
    ranked = spark.range(100).select(
        F.concat(F.lit("S"), "id").alias("symbol"), F.concat(F.lit("sector"), (F.col("id") % 3).cast("string")).alias("sector"),
        (F.col("id") % 7).cast("double").alias("score"))
    boards = trending.boards(ranked).orderBy("board", "rank").collect()
    by = {}
    for r in boards:
        by.setdefault(r.board, []).append((-r.score, r.symbol))
    assert set(by) == {"global", "sector0", "sector1", "sector2"}
    assert all(v == sorted(v) and len(v) == 10 for v in by.values())


def test_sector_and_window(tables):
    facts, tickers = tables
    assert [r.symbol for r in trending.trending_window(facts, tickers, "6h", AS_OF, "oil").collect()] == ["FUT"]
    with pytest.raises(ValueError):
        trending.trending_window(facts, tickers, "1y", AS_OF)


def test_detail(tables, spark):
    facts, tickers = tables
    asked = spark.createDataFrame([("nvda",), ("old",), ("nope",)], "symbol string")
    got = {r.symbol: r for r in ticker.ticker_detail(asked, tickers, facts, "24h", AS_OF).collect()}
    assert not got["NOPE"].found and got["NOPE"].score is None
    assert got["OLD"].found and (got["OLD"].mentions_24h, got["OLD"].score, got["OLD"].sentiment, got["OLD"].spike) == (0, 0.0, None, False)
    assert (got["NVDA"].mentions_1h, got["NVDA"].mentions_24h, got["NVDA"].score) == (30, 40, 30 * 3 + 40 * 1.5 + 1.0)


def test_news_limit_applies_before_titles(tables, spark):
    facts, tickers = tables
    asked = spark.createDataFrame([("NVDA",)], "symbol string")
    got = ticker.ticker_news(asked, facts, "24h", AS_OF, limit=5).collect()
    assert len(got) == 1 and got[0].title == "NVDA - Wire"
    for bad in (0, 201):
        with pytest.raises(ValueError):
            ticker.ticker_news(asked, facts, "24h", AS_OF, limit=bad)


def test_title_rules(spark):
    news = spark.sql("""select * from values
      ('A', 1L, 'X - Reuters', timestamp'2024-01-01 00:00:00'), ('A', 2L, 'x - AP', timestamp'2024-01-01 01:00:00'),
      ('A', 3L, cast(null as string), timestamp'2024-01-01 02:00:00'), ('A', 4L, cast(null as string), timestamp'2024-01-01 03:00:00')
      as t(symbol, id, title, timestamp)""")
    assert sorted(r.id for r in topk.dedupe_titles(news, ["symbol"]).collect()) == [2, 3, 4]
    assert sorted(r.id for r in topk.dedupe_exact_titles(news, ["symbol"]).collect()) == [1, 2, 3, 4]


def test_one_pass_metrics_equal_separate_aggregates(tables):
    facts, _ = tables
    one = {r.ticker: r for r in fx.ticker_metrics(facts, AS_OF, 24).collect()}
    stats = {r.ticker: r for r in fx.baseline_stats(fx.hourly_mentions(facts, AS_OF)).collect()}
    mood = {r.ticker: r.weighted_sentiment for r in fx.weighted_sentiment(facts, AS_OF).collect()}
    last = {r.ticker: r.mentions for r in fx.mentions_last(facts, AS_OF, 1).collect()}
    for t, r in one.items():
        assert r.mentions_1h == last.get(t, 0) and r.weighted_sentiment == mood.get(t)
        assert (r.mu, r.sigma) == ((stats[t].mu, stats[t].sigma) if t in stats else (None, None))
