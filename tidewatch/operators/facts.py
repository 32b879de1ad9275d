"""Mention facts and the aggregates over them.

All per-ticker figures of a board come from one pass: mentions are reduced to
(ticker, hour) on the map side, then to one row per ticker, so a ticker with a
third of all mentions costs no more than any other.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, times, vocab
from .filters import after, counted, exclude_sources, filter_sector, since


def mention_facts(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Mention rows with the source, time, title and URL of their article.

    Tables laid out by `write_feed` share the partition column `dt`; it then
    takes part in the join, so a window on the articles prunes the mentions.
    """
    on = ["article_id"] + (["dt"] if "dt" in mentions.columns and "dt" in articles.columns else [])
    kept = [c for c in ("source", "timestamp", "title", "url") if c in articles.columns]
    # a shared date on both sides lets a window prune both tables
    right = articles.select(F.col("id").alias("article_id"), *on[1:], *kept)
    left = mentions.withColumnRenamed("id", "mention_id")
    return left.drop(*[c for c in kept if c in left.columns], "created_at").join(right, on)


def _units() -> tuple[Column, Column]:
    """Weighted sentiment and weight of a row as exact integers; NULL without sentiment."""
    s = scores.sentiment_units("sentiment")
    w = scores.weight_units("source_weight")
    return s * w, F.when(F.col("sentiment").isNotNull(), w)


def _weighted(sw: Column, w: Column) -> Column:
    return scores.ratio(sw, w) / F.lit(float(scores.SENTIMENT_UNIT))


def hourly_mentions(facts: DataFrame, as_of: dt.datetime, hours: int = vocab.BASELINE_HOURS) -> DataFrame:
    """Counted mentions per ticker and clock hour."""
    return (
        exclude_sources(since(facts, as_of, hours))
        .groupBy("ticker", F.date_trunc("hour", "timestamp").alias("hour_bucket"))
        .agg(F.count("*").alias("mentions"))
    )


def _mean_and_deviation(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from a count, a sum and a sum of squares (all integers)."""
    mu = scores.ratio(s1, n)
    spread = (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double")
    return mu, F.when(n > 1, F.sqrt(spread))


def baseline_stats(hourly: DataFrame) -> DataFrame:
    """Mean and sample deviation over the hours that have mentions."""
    sums = hourly.groupBy("ticker").agg(
        F.count("*").alias("n"), F.sum("mentions").alias("s1"), F.sum(F.col("mentions") * F.col("mentions")).alias("s2")
    )
    mu, sigma = _mean_and_deviation(F.col("n"), F.col("s1"), F.col("s2"))
    return sums.select("ticker", mu.alias("mu"), sigma.alias("sigma"))


def mentions_last(facts: DataFrame, as_of: dt.datetime, hours: float, name: str = "mentions") -> DataFrame:
    """Counted mentions per ticker in the last `hours`."""
    return exclude_sources(since(facts, as_of, hours)).groupBy("ticker").agg(F.count("*").alias(name))


def weighted_sentiment(facts: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    """Authority-weighted mean sentiment per ticker, over all sources."""
    sw, w = _units()
    recent = since(facts, as_of, hours).filter(F.col("sentiment").isNotNull())
    return recent.groupBy("ticker").agg(_weighted(F.sum(sw), F.sum(w)).alias("weighted_sentiment"))


def window_mentions(facts: DataFrame, tickers: DataFrame, as_of: dt.datetime, hours: float,
                    sector: str | None = None) -> DataFrame:
    """Counted mentions of known tickers, optionally of one sector."""
    known = filter_sector(tickers, sector).select(F.col("symbol").alias("ticker"))
    return mentions_last(facts.join(known, "ticker", "left_semi"), as_of, hours)


def window_sentiment(facts: DataFrame, mentioned: DataFrame, as_of: dt.datetime, hours: float) -> DataFrame:
    """Weighted sentiment of the tickers in `mentioned`."""
    return weighted_sentiment(facts.join(mentioned.select("ticker"), "ticker", "left_semi"), as_of, hours)


def ticker_metrics(facts: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """Every figure of a board, one row per ticker mentioned in the baseline period."""
    return _metrics(_hourly(facts, as_of, hours))


def _hourly(facts: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    horizon = max(hours, vocab.BASELINE_HOURS)
    base = since(facts, as_of, horizon)
    in_hour = after(base, as_of, dt.timedelta(hours=1))
    in_window = after(base, as_of, dt.timedelta(hours=hours))
    in_baseline = after(base, as_of, dt.timedelta(hours=vocab.BASELINE_HOURS))
    sw, w = _units()
    return base.groupBy("ticker", F.date_trunc("hour", "timestamp").alias("hour_bucket")).agg(
        F.count_if(counted() & in_baseline).alias("n"),
        F.count_if(counted() & in_hour).alias("m1h"),
        F.count_if(counted() & in_window).alias("mw"),
        F.sum(F.when(in_window, sw)).alias("sw"),
        F.sum(F.when(in_window, w)).alias("w"),
    )
def _metrics(hourly: DataFrame) -> DataFrame:
    """Figures per ticker from rows per ticker and hour: n counted in the baseline, m1h and mw in the windows, sentiment and weight units."""
    sums = hourly.groupBy("ticker").agg(
        F.count_if(F.col("n") > 0).alias("hours"),
        F.sum("n").alias("s1"),
        F.sum(F.col("n") * F.col("n")).alias("s2"),
        F.sum("m1h").alias("mentions_1h"),
        F.sum("mw").alias("mentions"),
        _weighted(F.sum("sw"), F.sum("w")).alias("weighted_sentiment"),
    )
    mu, sigma = _mean_and_deviation(F.col("hours"), F.col("s1"), F.col("s2"))
    return sums.select(
        "ticker", "mentions_1h", "mentions", "weighted_sentiment", mu.alias("mu"), sigma.alias("sigma")
    )


def hour_sums(facts: DataFrame) -> DataFrame:
    """Mergeable sums per ticker and clock hour: counted mentions, weighted sentiment and weight units, newest time.

    Whole numbers, so sums of several batches merge exactly in any order.
    """
    sw, w = _units()
    return facts.groupBy("ticker", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count_if(counted()).alias("n"), F.sum(sw).alias("sw"), F.sum(w).alias("w"), F.max("timestamp").alias("latest"))


def _edges(as_of: dt.datetime, hours: int) -> list[dt.datetime]:
    """The clock hours in which a window of a board begins."""
    starts = (as_of - dt.timedelta(hours=h) for h in (1, hours, max(hours, vocab.BASELINE_HOURS), vocab.BASELINE_HOURS))
    return sorted({s.replace(minute=0, second=0, microsecond=0) for s in starts})


def metrics_from_sums(sums: DataFrame, facts: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """ticker_metrics() from hour_sums(): mentions themselves are read of the few hours only in which a window begins."""
    edges = _edges(as_of, hours)
    span = dt.timedelta(hours=1)
    at = lambda t: times.literal_like(facts, "timestamp", t)
    part = facts.filter(functools.reduce(Column.__or__, ((F.col("timestamp") >= at(e)) & (F.col("timestamp") < at(e + span)) for e in edges)))
    if "dt" in facts.columns:
        part = part.filter(F.col("dt").isin([times.utc(e).date() for e in edges]))
    hour = lambda t: times.literal_like(sums, "hour", t)
    whole = sums.filter((F.col("hour") >= hour(edges[0])) & ~F.col("hour").isin(*(hour(e) for e in edges)))
    if "dt" in sums.columns:
        whole = whole.filter(F.col("dt") >= F.lit(times.utc(edges[0]).date()))
    inside = lambda h: F.col("hour") >= hour(as_of - dt.timedelta(hours=h))
    merged = whole.groupBy("ticker", "hour").agg(F.sum("n").alias("c"), F.sum("sw").alias("sw"), F.sum("w").alias("w")).select(
        "ticker", F.col("hour").alias("hour_bucket"), F.when(inside(vocab.BASELINE_HOURS), F.col("c")).otherwise(0).alias("n"),
        F.when(inside(1), F.col("c")).otherwise(0).alias("m1h"), F.when(inside(hours), F.col("c")).otherwise(0).alias("mw"),
        F.when(inside(hours), F.col("sw")).alias("sw"), F.when(inside(hours), F.col("w")).alias("w"))
    return _metrics(merged.unionByName(_hourly(part, as_of, hours)))


def _recent_counts(facts: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """1 h count, window count and plain mean sentiment per ticker, all given sources."""
    base = since(facts, as_of, hours)
    return base.groupBy("ticker").agg(
        F.count_if(after(base, as_of, dt.timedelta(hours=1))).alias("mentions_1h"),
        F.count("*").alias("mentions"),
        scores.exact_mean(scores.sentiment_units("sentiment")).alias("avg_sentiment"),
    )


def ticker_scores(tickers: DataFrame, facts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Search score per ticker; tickers without mentions stay with 0."""
    agg = _recent_counts(facts, as_of, 24).select("ticker", "mentions", "avg_sentiment")
    m = F.coalesce("mentions", F.lit(0))
    s = F.coalesce("avg_sentiment", F.lit(0.0))
    return tickers.join(agg, tickers["symbol"] == agg["ticker"], "left").select(
        "symbol", "company_name", "sector",
        scores.round4(scores.search_score(m, s)).alias("score"),
        m.alias("mentions_24h"),
        scores.round4(s).alias("sentiment"),
    )


def trend_data(symbols: DataFrame, facts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Trend row of each requested symbol; no source is excluded."""
    wanted = symbols.select("symbol").distinct()
    agg = _recent_counts(facts, as_of, 24)
    m1 = F.coalesce("mentions_1h", F.lit(0))
    m = F.coalesce("mentions", F.lit(0))
    s = F.coalesce("avg_sentiment", F.lit(0.0))
    return wanted.join(agg, wanted["symbol"] == agg["ticker"], "left").select(
        "symbol", m1.alias("mentions_1h"), m.alias("mentions_24h"), scores.round4(s).alias("sentiment"),
        scores.round4(scores.trend_data_score(m1, m, s)).alias("score"),
        scores.velocity_spike(m1, m, 24).alias("spike"),
    )


def gauge_15m(facts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mean sentiment of the last 15 minutes."""
    recent = exclude_sources(since(facts, as_of, 0.25))
    return recent.groupBy("ticker").agg(
        scores.round4(scores.exact_mean(scores.sentiment_units("sentiment"))).alias("gauge_sentiment_15m")
    )


def detail_metrics(facts: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """Counts, mean sentiment and the 15-minute gauge per ticker in one pass."""
    base = exclude_sources(since(facts, as_of, max(hours, 1)))
    units = scores.sentiment_units("sentiment")
    recent = F.when(after(base, as_of, dt.timedelta(minutes=15)), units)
    return base.groupBy("ticker").agg(
        F.count_if(after(base, as_of, dt.timedelta(hours=1))).alias("mentions_1h"),
        F.count_if(after(base, as_of, dt.timedelta(hours=hours))).alias("mentions"),
        scores.exact_mean(units).alias("avg_sentiment"),
        scores.round4(scores.exact_mean(recent)).alias("gauge_sentiment_15m"),
    )


def article_sentiment(mentions: DataFrame) -> DataFrame:
    """Mean sentiment per article over its mentions."""
    return mentions.groupBy("article_id").agg(
        scores.exact_mean(scores.sentiment_units("sentiment")).alias("sentiment")
    )


def related_tickers(article_ids: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct tickers mentioned by a set of articles (column `article_id`)."""
    wanted = article_ids.select("article_id").distinct()
    return mentions.join(wanted, "article_id", "left_semi").select(F.col("ticker").alias("symbol")).distinct()


def mention_leaders(items: DataFrame, n: int = 15, column: str = "tickers") -> DataFrame:
    """Most mentioned tickers of a run."""
    counts = items.select(F.explode(column).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("mentions"))
    return counts.orderBy(F.desc("mentions"), "symbol").limit(n)


def run_summary(items: DataFrame, column: str = "tickers") -> DataFrame:
    """Totals of a run: items and ticker mentions."""
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("bigint").alias("mentions"))


def board_summary(ranked: DataFrame) -> DataFrame:
    """Totals of a ranking: tickers and sectors."""
    return ranked.groupBy("sector").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tickers"), F.count("*").alias("sectors")
    )


def ticker_profile(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """Requested symbols, upper-cased, with their profile and a found flag."""
    wanted = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    known = tickers.select("symbol", "sector", "company_name", F.lit(True).alias("_hit"))
    return wanted.join(known, "symbol", "left").select(
        "symbol", "sector", "company_name", F.coalesce("_hit", F.lit(False)).alias("found")
    )
