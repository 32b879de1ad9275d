"""Attention boards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, vocab
from ..operators import facts as fx
from ..operators import topk
from ..operators.filters import filter_sector, window_hours


def rank_tickers(facts: DataFrame, tickers: DataFrame, as_of: dt.datetime, hours: int = 24,
                 sector: str | None = None) -> DataFrame:
    """Score of every known ticker with a counted mention in the window.

    The dimension join is left to the optimizer, which broadcasts it only when
    its measured size allows.
    """
    wanted = filter_sector(tickers, sector)
    if sector:
        facts = facts.join(wanted.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
    return _ranked(fx.ticker_metrics(facts, as_of, hours), wanted)


def _ranked(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    metrics = metrics.filter("mentions > 0")
    z = scores.z_score("mentions_1h", "mu", "sigma")
    named = metrics.join(wanted, F.col("ticker") == F.col("symbol")).select(
        "symbol",
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        "mentions_1h",
        F.col("mentions").alias("mentions_24h"),
        F.coalesce("weighted_sentiment", F.lit(0.0)).alias("_s"),
        z.alias("_z"),
    )
    raw = scores.trend_score(F.col("_z"), F.col("mentions_24h"), F.col("_s"), F.lit(0.0))
    return named.select(
        "symbol", "sector", "company_name",
        scores.round4(scores.boost(raw, F.col("_z"))).alias("score"),
        "mentions_1h", "mentions_24h",
        scores.round4("_s").alias("sentiment"),
        F.lit(0.0).alias("price_change_pct"),
        scores.round4("_z").alias("z_score"),
        scores.spike(F.col("_z")).alias("spike"),
    )


def boards(ranked: DataFrame, n: int = vocab.BOARD_SIZE) -> DataFrame:
    """The global board and one board per sector, from one pass over the ranking."""
    spread = ranked.select(F.explode(F.array(F.lit(vocab.GLOBAL_BOARD), "sector")).alias("board"), "*")
    return topk.top_per_group(spread, ["board"], [F.desc("score"), F.asc("symbol")], n, "rank")


def trending(facts: DataFrame, tickers: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Boards over the last 24 hours."""
    return boards(rank_tickers(facts, tickers, as_of))


def trending_from_sums(sums: DataFrame, facts: DataFrame, tickers: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Boards over the last 24 hours from the sums per hour that a stream keeps; equal to trending() of all facts."""
    return boards(_ranked(fx.metrics_from_sums(sums, facts, as_of, 24), tickers))


def trending_window(facts: DataFrame, tickers: DataFrame, window: str, as_of: dt.datetime,
                    sector: str | None = None, n: int = vocab.BOARD_SIZE) -> DataFrame:
    """Top tickers of any window, globally or for one sector or sector alias."""
    return topk.top_global(rank_tickers(facts, tickers, as_of, window_hours(window), sector), n)
