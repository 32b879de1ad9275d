"""Ticker pages: profile, news and sentiment timeline, for any number of symbols."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, vocab
from ..operators import facts as fx
from ..operators import timeline as tl
from ..operators import topk
from ..operators.filters import exclude_sources, filter_symbols, in_window, window_hours


def ticker_detail(symbols: DataFrame, tickers: DataFrame, facts: DataFrame, window: str,
                  as_of: dt.datetime) -> DataFrame:
    """Profile and trend metrics; unknown symbols come back with found = false."""
    hours = window_hours(window)
    profile = fx.ticker_profile(symbols, tickers)
    metrics = fx.detail_metrics(filter_symbols(facts, profile.filter("found")), as_of, hours)
    joined = profile.join(metrics.withColumnRenamed("ticker", "symbol"), "symbol", "left")
    m1, m = F.coalesce("mentions_1h", F.lit(0)), F.coalesce("mentions", F.lit(0))
    s = F.coalesce("avg_sentiment", F.lit(0.0))
    found = F.col("found")
    return joined.select(
        "symbol", "company_name", "sector", "found",
        F.when(found, m1).alias("mentions_1h"),
        F.when(found, m).alias("mentions_24h"),
        scores.round4("avg_sentiment").alias("sentiment"),
        F.when(found, scores.round4(scores.detail_score(m1, m, s))).alias("score"),
        F.when(found, scores.velocity_spike(m1, m, hours)).alias("spike"),
        "gauge_sentiment_15m",
    )


def ticker_news(symbols: DataFrame, facts: DataFrame, window: str, as_of: dt.datetime,
                limit: int | None = None) -> DataFrame:
    """Newest articles per symbol, cut to `limit`, then one per outlet-stripped title."""
    limit = vocab.NEWS_LIMIT[window] if limit is None else limit
    if not 1 <= limit <= vocab.MAX_NEWS_LIMIT:
        raise ValueError(f"limit must be 1..{vocab.MAX_NEWS_LIMIT}")
    wanted = symbols.select(F.upper("symbol").alias("symbol"))
    recent = exclude_sources(in_window(filter_symbols(facts, wanted), window, as_of))
    page = topk.top_per_group(
        recent.select(F.col("ticker").alias("symbol"), F.col("article_id").alias("id"), "source", "title", "url",
                      "timestamp", scores.round4("sentiment").alias("sentiment"), "mention_id"),
        ["symbol"], [F.desc("timestamp"), F.asc("id"), F.asc("mention_id")], limit,
    )
    return topk.dedupe_titles(page.drop("mention_id"), ["symbol"])


def ticker_timeline(symbols: DataFrame, facts: DataFrame, window: str, as_of: dt.datetime) -> DataFrame:
    """Bucketed sentiment of the news page of each symbol."""
    news = topk.dedupe_exact_titles(ticker_news(symbols, facts, window, as_of), ["symbol"])
    return tl.sentiment_timeline(news, window)
