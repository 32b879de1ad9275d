import random

import pytest

from tidewatch.operators import timeline


@pytest.fixture
def data(spark):
    rng = random.Random(3)
    nodes = {(s, rng.randrange(0, 40_000_000)): rng.randrange(1000) for s in "ABC" for _ in range(40)}
    points = {(s, rng.randrange(-5_000_000, 45_000_000)) for s in "ABCD" for _ in range(60)} | {k for k in list(nodes)[:10]}
    n = spark.createDataFrame([(s, t, float(v)) for (s, t), v in nodes.items()], "symbol string, ts long, sentiment double")
    p = spark.createDataFrame(sorted(points), "symbol string, ts long")
    return nodes, points, n, p


def around(nodes, s, t):
    mine = sorted(k[1] for k in nodes if k[0] == s)
    return max((x for x in mine if x <= t), default=None), min((x for x in mine if x >= t), default=None)


def test_neighbours(data):
    nodes, points, n, p = data
    got = {(r.symbol, r.ts): (r.prev and r.prev.ts, r.next and r.next.ts) for r in timeline.neighbours(p, n, []).collect()}
    assert got == {(s, t): around(nodes, s, t) for s, t in points}


def test_interpolation(data):
    nodes, points, n, p = data
    got = {(r.symbol, r.ts): r.sentiment for r in timeline.interpolate_timeline(p, n).collect()}
    for s, t in points:
        a, b = around(nodes, s, t)
        if a is None and b is None:
            expected = None
        elif a is None or b is None or a == b:
            expected = nodes[s, b if a is None else a]
        else:
            expected = nodes[s, a] + (t - a) / (b - a) * (nodes[s, b] - nodes[s, a])
        assert got[s, t] == (None if expected is None else pytest.approx(expected))


def test_nearest_prefers_the_earlier_on_ties(spark):
    n = spark.createDataFrame([("A", 10, "1970-01-01 00:00:01"), ("A", 11, "1970-01-01 00:00:03")], "symbol string, id long, t string")
    n = n.selectExpr("symbol", "id", "cast(t as timestamp) as timestamp")
    p = spark.createDataFrame([("A", 2000), ("A", 2001), ("A", 0), ("B", 5)], "symbol string, ts long")
    got = {(r.symbol, r.ts): r.article_id for r in timeline.nearest_article(p, n).collect()}
    assert got == {("A", 2000): 10, ("A", 2001): 11, ("A", 0): 10, ("B", 5): None}


def test_timeline_counts_missing_sentiment_as_zero(spark):
    news = spark.sql("""
      select * from values ('A', 2L, timestamp'2024-01-01 00:10:00', 0.6D), ('A', 1L, timestamp'2024-01-01 00:20:00', cast(null as double)),
        ('A', 3L, timestamp'2024-01-01 00:40:00', -0.2D) as t(symbol, id, timestamp, sentiment)""")
    got = [(r.sentiment, r.mentions, r.article_id) for r in timeline.sentiment_timeline(news, "6h").orderBy("ts").collect()]
    assert got == [(0.3, 2, 2), (-0.2, 1, 3)]
