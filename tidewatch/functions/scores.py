"""Scores, sentiment classes and the exact arithmetic behind them.

Sentiments are summed as integer micro-units and weights as integer
hundredths.  Integer sums do not depend on row order, so a retried task, a
different partitioning or another engine gives the same last digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

SENTIMENT_UNIT = 1_000_000
WEIGHT_UNIT = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_units(sentiment: Column | str) -> Column:
    """Sentiment as BIGINT micro-units."""
    return F.floor(_col(sentiment) * F.lit(float(SENTIMENT_UNIT)) + F.lit(0.5)).cast("bigint")


def weight_units(weight: Column | str) -> Column:
    """Weight as BIGINT hundredths."""
    return F.floor(_col(weight) * F.lit(float(WEIGHT_UNIT)) + F.lit(0.5)).cast("bigint")


def round4(value: Column | str) -> Column:
    """Half-up rounding to four decimals using plain IEEE operations."""
    return F.floor(_col(value) * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL on a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def z_score(recent: Column | str, mu: Column | str, sigma: Column | str) -> Column:
    """Standardised recent count; 0 without history or without spread."""
    sigma = _col(sigma)
    return F.when(sigma.isNull() | (sigma == 0), F.lit(0.0)).otherwise(
        (F.coalesce(_col(recent), F.lit(0)) - _col(mu)) / sigma
    )


def trend_score(z: Column, mentions: Column, sentiment: Column, price_change: Column | None = None) -> Column:
    """Board score before the spike boost."""
    score = z * F.lit(2.0) + mentions * F.lit(0.3) + sentiment * F.lit(2.0)
    return score if price_change is None else score + price_change * F.lit(2.0)


def spike(z: Column) -> Column:
    return z >= F.lit(vocab.SPIKE_Z)


def boost(score: Column, z: Column) -> Column:
    """Raise the score of a spiking ticker."""
    return F.when(spike(z), score * F.lit(vocab.SPIKE_BOOST)).otherwise(score)


def search_score(mentions_24h: Column, sentiment: Column) -> Column:
    return mentions_24h * F.lit(1.5) + sentiment * F.lit(2.0)


def detail_score(mentions_1h: Column, mentions: Column, sentiment: Column) -> Column:
    """Ticker-page score, also used for the trend rows of a search result."""
    return mentions_1h * F.lit(3.0) + mentions * F.lit(1.5) + sentiment * F.lit(2.0)


trend_data_score = detail_score


def velocity_spike(mentions_1h: Column, mentions: Column, hours: int) -> Column:
    """Last hour above twice the hourly average of the window."""
    hourly = mentions.cast("double") / F.lit(float(hours))
    return (mentions > 0) & (mentions_1h.cast("double") > hourly * F.lit(2.0))


def clamp_unit(value: Column | str) -> Column:
    """Limit to [-1, 1], NULL stays NULL."""
    v = _col(value).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def clamp_sentiment(value: Column | str) -> Column:
    """Round to four decimals, then limit to [-1, 1]."""
    return clamp_unit(round4(_col(value).cast("double")))


def sentiment_class(value: Column | str) -> Column:
    """positive / negative / neutral at +-0.05; NULL is neutral."""
    v = _col(value)
    return F.when(v > 0.05, "positive").when(v < -0.05, "negative").otherwise("neutral")


def sentiment_band(value: Column | str) -> Column:
    """Five-level gauge label."""
    v = _col(value)
    return (
        F.when(v >= 0.5, "Bullish")
        .when(v <= -0.5, "Bearish")
        .when(v > 0.1, "Slightly Bullish")
        .when(v < -0.1, "Slightly Bearish")
        .otherwise("Neutral")
    )


def lookup(key: Column, table: dict, default: Column) -> Column:
    """CASE over a small fixed dict; stays in generated code."""
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F)
    return chain.otherwise(default)


def source_weight(source: Column | str) -> Column:
    """Authority weight of a source."""
    return lookup(_col(source), vocab.SOURCE_WEIGHTS, F.lit(vocab.DEFAULT_WEIGHT))


def resolve_sector(name: Column | str) -> Column:
    """Sector alias -> dimension spelling; anything else passes through."""
    c = _col(name)
    return lookup(F.lower(c), vocab.SECTOR_KEYWORDS, c)


def exact_mean(units: Column, scale: int = SENTIMENT_UNIT) -> Column:
    """Mean of integer units as a double; an aggregate expression."""
    return ratio(F.sum(units), F.count(units)) / F.lit(float(scale))
