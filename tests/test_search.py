import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models
from tidewatch.sources import postings
from tidewatch.plans import search as sx

AS_OF = dt.datetime(2024, 1, 8, 12, 0)


def classify(spark, *queries, mode="substring"):
    df = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    return {r.query_id: r for r in sx.classify_queries(df, mode).collect()}


def test_intents(spark):
    got = classify(spark, "AI stocks", "$TSLA", "earnings beat", "cloud growth", "retail", "GOOGLE", "  health care ")
    assert (got["AI stocks"].intent, got["AI stocks"].sectors) == ("sector_search", ["Technology"])
    assert (got["$TSLA"].intent, got["$TSLA"].tickers) == ("ticker_lookup", ["TSLA"])
    assert got["earnings beat"].intent == "news_search"
    assert (got["cloud growth"].intent, got["cloud growth"].keywords) == ("general_search", ["cloud", "growth"])
    assert got["retail"].sectors == ["Technology", "Consumer Discretionary"]
    assert got["GOOGLE"].tickers == ["OOGLE"]
    assert got["  health care "].sectors == ["Healthcare"] and got["  health care "].raw_query == "health care"


def test_whole_word_mode(spark):
    assert classify(spark, "retail", mode="word")["retail"].sectors == ["Consumer Discretionary"]


@pytest.fixture
def tables(spark):
    ts = AS_OF.replace(hour=11)
    tickers = spark.createDataFrame(
        [("AAA", "Energy", "Alpha Oil"), ("BBB", "Energy", "Beta Gas"), ("CCC", "Technology", "Alphabet")],
        "symbol string, sector string, company_name string")
    articles = spark.createDataFrame([
        (1, "gdelt", "alpha rises", "strong quarter", "u1", ts), (2, "gdelt", "alpha rises again", "x", "u1", ts),
        (3, "newsapi", "beta falls", "weak_quarter", "u2", ts - dt.timedelta(days=9)), (4, "newsapi", None, "nothing", None, ts),
    ], "id long, source string, title string, content string, url string, timestamp timestamp_ntz")
    mentions = spark.createDataFrame(
        [(1, "AAA", 1, 0.5, 0.75), (2, "AAA", 2, None, 0.75), (3, "BBB", 3, -0.5, 0.8), (4, "CCC", 1, 0.1, 0.75)],
        "id long, ticker string, article_id long, sentiment double, source_weight double")
    return tickers, articles, mentions


def run(spark, tables, *queries, embedded=True):
    tickers, articles, mentions = tables
    df = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    if embedded:
        articles = articles.withColumn("embedding", models.hashed_vector("title"))
        df = df.withColumn("embedding", models.hashed_vector("query"))
    return sx.search(df, tickers, articles, mentions, AS_OF)


def listed(df, query, column):
    return [r[column] for r in df.filter(F.col("query_id") == query).orderBy("rank").collect()]


def test_sector_question(spark, tables):
    r = run(spark, tables, "oil stocks")
    assert listed(r.tickers, "oil stocks", "symbol") == ["AAA", "BBB"]
    assert listed(r.tickers, "oil stocks", "mentions_24h") == [2, 0]
    assert listed(r.news, "oil stocks", "id") == [2, 3]
    assert listed(r.trends, "oil stocks", "symbol") == ["AAA", "BBB"]


def test_ticker_question_and_fallback(spark, tables):
    r = run(spark, tables, "$BBB", "ALPHA")
    assert listed(r.tickers, "$BBB", "symbol") == ["BBB"]
    assert listed(r.tickers, "ALPHA", "symbol") == ["AAA", "CCC"]
    assert listed(r.tickers, "ALPHA", "score") == [0.0, 0.0]
    assert listed(r.news, "ALPHA", "id") == [2, 1][:1] or listed(r.news, "ALPHA", "id") == [2]


def test_semantic_question(spark, tables):
    r = run(spark, tables, "alpha rises")
    assert listed(r.news, "alpha rises", "id")[0] == 1
    assert set(listed(r.tickers, "alpha rises", "symbol")) == {"AAA", "BBB", "CCC"}
    assert listed(r.news, "alpha rises", "sentiment")[0] == 0.3


def test_cold_start_uses_keywords_then_partial_matches(spark, tables):
    r = run(spark, tables, "alpha quarter", "beta gaslight", "alphabe", embedded=False)
    assert sorted(listed(r.news, "alpha quarter", "id")) == [2, 3]
    assert listed(r.tickers, "alphabe", "symbol") == ["CCC"] and listed(r.news, "alphabe", "id") == []


def test_nested(spark, tables):
    r = run(spark, tables, "oil stocks", "zzz")
    rows = {x.query_id: x for x in r.nested().collect()}
    assert [t.symbol for t in rows["oil stocks"].tickers] == ["AAA", "BBB"]
    assert rows["zzz"].intent == "general_search"


def by_query(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.query_id, set()).add(row.id)
    return out


def test_batch_keywords_equal_single(spark, tables):
    _, articles, _ = tables
    queries = ["alpha quarter", "falls of x", "nothing rises", "weak_q", "weakxq", "rise%", "of x", "ÀLPHA"]
    log = spark.createDataFrame([(q, q) for q in queries], "query_id string, raw_query string")
    batch = by_query(sx.keyword_search_batch(log, articles))
    for q in queries:
        assert batch.get(q, set()) == {r.id for r in sx.keyword_search(articles, q).collect()}, q


def test_one_word_in_every_query(spark):
    """A hot word is cut to what can matter; the newest k per URL stay exact."""
    rng = random.Random(2)
    words = ["news", "stock", "rally", "crash", "newsroom", "quiet"]
    rows = [(i, "s", " ".join(rng.choices(words, k=2)), f"{rng.choice(words)}\nnews", f"u{rng.randrange(25)}",
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200))) for i in range(150)]
    articles = spark.createDataFrame(rows, "id long, source string, title string, content string, url string, timestamp timestamp")
    queries = ["news"] + [f"news {w}" for w in words[1:]] + [f"{a} {b}" for a in words for b in words if a < b]
    log = spark.createDataFrame([(q, q) for q in queries], "query_id string, raw_query string")
    batch = by_query(sx.keyword_search_batch(log, articles, 4))
    assert batch == {q: {r.id for r in sx.keyword_search(articles, q, 4).collect()} for q in queries}


def test_queries_without_a_vector_go_to_keywords(spark, tables):
    tickers, articles, mentions = tables
    articles = articles.withColumn("embedding", models.hashed_vector("title"))
    queries = ["alpha rises", "alpha quarter"]
    df = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    df = df.withColumn("embedding", F.when(F.col("query") == queries[0], models.hashed_vector("query")))
    r = sx.search(df, tickers, articles, mentions, AS_OF)
    assert listed(r.news, queries[0], "id")[0] == 1
    assert sorted(listed(r.news, queries[1], "id")) == [2, 3]


def test_partial_match_is_limited_and_unique(spark):
    tickers = spark.range(20).select(
        F.format_string("S%02d", "id").alias("symbol"), F.lit("X").alias("sector"), F.lit("Common Name").alias("company_name"))
    terms = spark.createDataFrame([("q", 0, "COMMON"), ("q", 1, "s0"), ("q", 2, "name"), ("r", 0, "o")], "query_id string, pos int, term string")
    got = {}
    for r in sx.partial_ticker_match(tickers, terms).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.symbol))
    assert sorted(got["q"]) == [(0, f"S0{i}") for i in range(5)]
    assert sorted(s for _, s in got["r"]) == [f"S0{i}" for i in range(5)]


@pytest.mark.parametrize("n", [100, 800])
def test_a_beaten_common_word_brings_a_bounded_number_of_rows(spark, n):
    """Every URL has a newer row of another word; what queries get to meet does not grow with the URLs."""
    rows = [(w, f"u{i}", 2 * i + (w == "other"), i) for i in range(n) for w in ("common", "other")]
    table = spark.createDataFrame(rows, "word string, url string, id long, timestamp long")
    asked = spark.createDataFrame([(["common"],), (["common", "other"],), (["common", "rare"],)], "_asked array<string>")
    kept = postings.useful(table, "word", 5, asked)
    assert kept.filter("word = 'common' and array_contains(_beaten, 'other')").count() == 5
    assert kept.count() == 10
    apart = postings.useful(table, "word", 5, asked.filter("size(_asked) = 1"))
    newest = [r["id"] for r in apart.filter("word = 'common'").orderBy("id").collect()]
    assert newest == [2 * i for i in range(n - 5, n)] and apart.filter("size(_beaten) > 0").isEmpty()
