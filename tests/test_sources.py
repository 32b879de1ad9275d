import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import filters, setops
from tidewatch.sources import feeds, normalize

NOW = dt.datetime(2030, 1, 1)


def records(spark, docs, spec):
    lines = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return normalize.read_records(spark.createDataFrame(lines, "value string"), spec)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_newsapi(spark):
    raw = records(spark, [
        {"publishedAt": "2024-05-01T12:00:00Z", "title": "T", "content": "", "description": "D", "url": "u"},
        {"publishedAt": None, "title": None, "content": None},
    ], schema.NEWSAPI)
    a, b = rows(normalize.normalize_newsapi(raw, NOW))
    assert (a["title"], a["content"], a["url"], a["timestamp"]) == ("T", "D", "u", dt.datetime(2024, 5, 1, 12))
    assert (b["title"], b["content"], b["url"], b["timestamp"]) == ("", "", None, NOW)
    assert a["id"].startswith("newsapi-") and a["id"] != b["id"] and a["sentiment"] is None


def test_newsapi_rejects_unreadable_time(spark):
    raw = records(spark, [{"publishedAt": "soon", "title": "T"}], schema.NEWSAPI)
    with pytest.raises(Exception, match="unreadable"):
        normalize.normalize_newsapi(raw, NOW).collect()
    assert rows(normalize.normalize_newsapi(raw, NOW, strict=False))[0]["timestamp"] == NOW


def test_alphavantage(spark):
    raw = records(spark, [
        {"title": "T", "summary": "", "url": "u", "time_published": "20240501T120000", "overall_sentiment_score": "0.25",
         "ticker_sentiment": [{"ticker": "aapl", "ticker_sentiment_score": "0.5"}, {"ticker": "msft", "ticker_sentiment_score": "x"}]},
        {"title": "T", "url": "", "time_published": "bad", "overall_sentiment_score": "n/a"},
    ], schema.ALPHAVANTAGE)
    items = normalize.normalize_alphavantage(raw, NOW)
    a, b = rows(items)
    assert (a["content"], a["tickers"], a["sentiment"]) == ("T", ["AAPL", "MSFT"], 0.25)
    assert (b["url"], b["tickers"], b["sentiment"], b["timestamp"]) == (None, [], None, NOW)
    mentions = items.select(F.explode("tickers").alias("ticker"), F.lit(0.1).alias("sentiment"), "provider_scores")
    got = {r["ticker"]: r["sentiment"] for r in rows(normalize.prefer_provider_score(mentions))}
    assert got == {"AAPL": 0.5, "MSFT": 0.1}


def test_polygon_and_social(spark):
    p = rows(normalize.normalize_polygon(records(spark, [
        {"id": "7", "published_utc": "2024-05-01T12:00:00Z", "title": "T", "description": None, "article_url": "u", "tickers": ["a", "B"]},
        {"id": "8", "title": "T"}], schema.POLYGON), NOW))
    assert (p[0]["id"], p[0]["content"], p[0]["tickers"]) == ("polygon-7", "T", ["A", "B"]) and p[1]["tickers"] == []
    t = rows(normalize.normalize_tweets(records(spark, [{"id": "1", "text": "x", "created_at": "2024-05-01T12:00:00Z"}] * 3, schema.TWEET), NOW))
    assert len(t) == 1 and t[0]["title"] is None and t[0]["url"].endswith("/status/1")
    r = rows(normalize.normalize_reddit(records(spark, [
        {"id": "z", "title": "T", "selftext": "", "created_utc": 1714564800.0, "permalink": "/r/x"}], schema.REDDIT), NOW))
    assert (r[0]["content"], r[0]["url"], r[0]["timestamp"]) == ("T", "https://reddit.com/r/x", dt.datetime(2024, 5, 1, 12))


def test_finnhub(spark):
    tickers = spark.createDataFrame([("AAPL",), ("GE",)], "symbol string")
    raw = records(spark, [
        {"headline": "H", "summary": "", "url": "u", "datetime": "1714564800", "related": "ge, aapl ,ZZ,ge"},
        {"headline": "", "summary": "S", "url": "", "datetime": None, "related": ""},
    ], schema.FINNHUB_NEWS)
    got = {r["content"]: r for r in rows(normalize.normalize_finnhub_general(raw, tickers, NOW))}
    assert got["H"]["tickers"] == ["GE", "AAPL", "GE"] and got["S"]["tickers"] == []
    assert got["S"]["title"] is None and got["S"]["url"] is None and got["S"]["timestamp"] == NOW


def test_insider(spark):
    raw = records(spark, [
        {"symbol": "GE", "mspr": 1.5, "change": -1234567, "year": 2024, "month": 3},
        {"symbol": "GE", "mspr": -0.125, "year": 2024}, {"symbol": "GE", "change": 5}, "{broken",
    ], schema.INSIDER)
    a, b = rows(normalize.normalize_insider(raw, NOW))
    assert a["title"] == "GE insiders net buying 1,234,567 shares (MSPR +1.500) — 2024-03"
    assert a["sentiment"] == 1.0 and a["url"] == "finnhub://insider-sentiment/GE/2024-03"
    assert b["id"] == "finnhub-insider-GE-unknown" and "selling 0 shares" in b["title"]


def test_stocktwits(spark):
    def msg(i, basic, pos=0, body="b"):
        return {"id": i, "body": body, "created_at": "2024-05-01T12:00:00Z", "symbol": "GE", "pos": pos,
                "entities": {"sentiment": basic and {"basic": basic}}}

    raw = records(spark, [msg("1", "Bullish"), msg("2", "Bearish"), msg("3", None), msg("4", "Odd"), msg(None, "Bullish"),
                          msg("6", None, body="  "), msg("7", None, pos=30)], schema.STOCKTWITS)
    assert len(rows(normalize.normalize_stocktwits(raw, NOW))) == 5
    got = rows(normalize.normalize_stocktwits(raw, NOW, 30))
    assert [r["sentiment"] for r in got] == [1.0, -1.0, 0.0, 0.0]


def test_rss(spark):
    items = "".join(
        f"<item><title> N{i} - W </title><link>{'' if i == 2 else f'http://x/{i}'}</link><description></description></item>" for i in range(20))
    feed = spark.createDataFrame([("GE", f"<rss><channel>{items}</channel></rss>"), ("XX", "<rss><chan")], "feed string, xml string")
    assert len(rows(feeds.normalize_yahoo_rss(feed, NOW))) == 19  # no cap unless asked for
    got = rows(feeds.normalize_yahoo_rss(feed, NOW, 15))
    assert len(got) == 14 and {r["content"] for r in got} >= {"N0 - W", "N14 - W"} and got[0]["tickers"] == ["GE"]
    g = rows(feeds.normalize_google_rss(feed, NOW))
    assert g[0]["fingerprint"] == "N0" and g[0]["tickers"] == [] and g[0]["timestamp"] == NOW


def test_rss_files(spark, tmp_path):
    (tmp_path / "GE.xml").write_text("<rss><channel><item><title>T</title><link>http://x</link></item></channel></rss>")
    got = rows(feeds.normalize_yahoo_rss(feeds.read_feeds(spark, str(tmp_path)), NOW))
    assert [(r["id"], r["tickers"]) for r in got] == [("yahoo-GE-http://x", ["GE"])]


def test_gkg(spark):
    def line(url, themes, quotes="", extras="", n=27):
        c = [""] * 27
        c[1], c[4], c[8], c[22], c[26] = "20240501120000", url, themes, quotes, extras
        return ("\t".join(c[:n]),)

    lines = spark.createDataFrame([
        line(" http://a ", "ECON_IPO,1", "1,2,Ann,quote one", "<PAGE_TITLE>T</PAGE_TITLE>"), line("http://b", "BUS_EARNINGS,3"),
        line("ftp://c", "ECON_IPO,1"), line("http://d", "TAX,1"), line("http://e", "ECON_IPO,1", n=26),
    ], "value string")
    got = {r["url"]: r for r in rows(feeds.normalize_gdelt(feeds.gkg_rows(lines), NOW))}
    assert set(got) == {"http://a", "http://b"}
    assert (got["http://a"]["content"], got["http://a"]["title"]) == ("quote one", "T") and got["http://b"]["content"] == "http://b"


def test_union_and_guards(spark):
    a = spark.createDataFrame([("1", "s", "c", "http://u", ["A"])], "id string, source string, content string, url string, tickers array<string>")
    b = spark.createDataFrame([("2", "s", "c", "x", [])], "id string, source string, content string, url string, tickers array<string>")
    both = setops.select_feeds({"a": a, "b": b})
    assert both.count() == 2 and filters.valid_items(both, need_http=True).count() == 1
    assert filters.valid_items(both, need_tickers=True).count() == 1
    with pytest.raises(ValueError):
        setops.select_feeds({"a": a}, ["c"])


def test_priority_union(spark):
    first = spark.createDataFrame([("B", 2), ("C", 1)], "symbol string, position long")
    rest = spark.createDataFrame([("A",), ("B",), ("A",)], "symbol string")
    got = setops.priority_union(first, rest).orderBy("tier", "position", "symbol").collect()
    assert [r.symbol for r in got] == ["C", "B", "A"]


def test_gkg_lines_are_split_once(spark):
    """filters on the cells of a line must not repeat the making and splitting of it."""
    lines = spark.range(3).selectExpr("array_join(transform(sequence(0, 26), i -> concat('c', id)), '\\t') value")
    items = feeds.normalize_gdelt(feeds.gkg_rows(lines), dt.datetime(2024, 5, 1))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambda i#") == 1
    assert feeds.gkg_rows(lines).count() == 3 and feeds.gkg_rows(spark.createDataFrame([("a\tb",), (None,)], "value string")).count() == 0
