import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores
from tidewatch.operators import filters


def num(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


L = F.lit


def test_z_score_falls_back_to_zero(spark):
    assert num(spark, scores.z_score(L(5), L(2.0), L(None).cast("double"))) == 0.0
    assert num(spark, scores.z_score(L(5), L(2.0), L(0.0))) == 0.0
    assert num(spark, scores.z_score(L(None).cast("int"), L(2.0), L(4.0))) == -0.5


def test_worked_example(spark):
    z = num(spark, scores.z_score(L(21), L(5.96), L(7.5)))
    assert round(z, 4) == 2.0053
    raw = scores.trend_score(L(2.01), L(143), L(0.58), L(0.0))
    assert num(spark, scores.round4(scores.boost(raw, L(2.01)))) == 62.504


def test_spike_includes_the_threshold(spark):
    assert num(spark, scores.spike(L(2.0))) is True
    assert num(spark, scores.boost(L(10.0), L(2.0))) == 13.0
    assert num(spark, scores.boost(L(10.0), L(1.9999))) == 10.0


@pytest.mark.parametrize("value,expected", [(1.7, 1.0), (-9.0, -1.0), (0.12346, 0.1235), (None, None)])
def test_clamp(spark, value, expected):
    assert num(spark, scores.clamp_sentiment(L(value).cast("double"))) == expected


@pytest.mark.parametrize("value,band,sign", [
    (0.5, "Bullish", "positive"), (-0.5, "Bearish", "negative"), (0.11, "Slightly Bullish", "positive"),
    (-0.11, "Slightly Bearish", "negative"), (0.1, "Neutral", "positive"), (0.05, "Neutral", "neutral"), (None, "Neutral", "neutral"),
])
def test_bands(spark, value, band, sign):
    assert num(spark, scores.sentiment_band(L(value).cast("double"))) == band
    assert num(spark, scores.sentiment_class(L(value).cast("double"))) == sign


def test_velocity_spike(spark):
    assert num(spark, scores.velocity_spike(L(3), L(24), 24)) is True
    assert num(spark, scores.velocity_spike(L(2), L(24), 24)) is False
    assert num(spark, scores.velocity_spike(L(0), L(0), 24)) is False


def test_search_and_detail_scores(spark):
    assert num(spark, scores.search_score(L(4), L(0.5))) == 7.0
    assert num(spark, scores.detail_score(L(2), L(4), L(0.5))) == 13.0


def test_weights_and_sectors(spark):
    assert num(spark, scores.source_weight(L("gdelt"))) == 0.75
    assert num(spark, scores.source_weight(L("elsewhere"))) == 1.0
    assert num(spark, scores.resolve_sector(L("AI"))) == "Technology"
    assert num(spark, scores.resolve_sector(L("Energy"))) == "Energy"
    assert num(spark, scores.resolve_sector(L("Nonsense"))) == "Nonsense"


def test_unknown_window_is_rejected(spark):
    with pytest.raises(ValueError):
        filters.in_window(spark.range(1), "2w", dt.datetime(2024, 1, 1))
