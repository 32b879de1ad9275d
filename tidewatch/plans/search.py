"""Search: a table of queries in, tickers, news and trend rows per query out."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text, vocab
from ..operators import facts as fx
from ..operators import topk
from ..operators.dedup import first_per_key
from ..operators.vector import knn
from ..session import durable
from ..sources import postings as kept


class SearchResult(NamedTuple):
    """Flat results; every frame has query_id, and rank where order matters."""

    intents: DataFrame
    tickers: DataFrame
    news: DataFrame
    trends: DataFrame

    def nested(self) -> DataFrame:
        """One row per query with its three lists, as a search page shows them."""

        def listed(df: DataFrame, name: str) -> DataFrame:
            row = F.struct("rank", *[c for c in df.columns if c not in ("query_id", "rank")])
            return df.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias(name))

        out = self.intents.select("query_id", F.col("raw_query").alias("query"), "intent")
        for df, name in ((self.tickers, "tickers"), (self.news, "news"), (self.trends, "trend_data")):
            lists = listed(df, name)
            out = out.join(lists, "query_id", "left")
            out = out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
        return out


def classify_queries(queries: DataFrame, mode: str = "substring") -> DataFrame:
    """Intent, sectors, ticker candidates and keywords of each query.

    `mode="substring"` finds a sector word anywhere ("retail" also holds "ai");
    `mode="word"` asks for whole words.
    """
    q = text.strip("query")
    lower = F.lower(q)

    def has(word: str) -> Column:
        return lower.contains(word) if mode == "substring" else lower.rlike(rf"(?U)\b{word}\b")

    hits = [F.when(has(w), F.lit(sector)) for w, sector in vocab.SECTOR_KEYWORDS.items()]
    sectors = F.array_distinct(F.array_compact(F.array(*hits)))
    tickers = F.array_except(
        F.regexp_extract_all(q, F.lit(vocab.QUERY_TICKER), 1), F.array(*[F.lit(w) for w in vocab.QUERY_STOPWORDS])
    )
    newsy = F.lit(False)
    for word in vocab.NEWS_WORDS:
        newsy = newsy | lower.contains(word)
    parsed = queries.select(
        "query_id", q.alias("raw_query"), sectors.alias("sectors"), tickers.alias("tickers"),
        text.split_keywords(q).alias("keywords"), newsy.alias("_newsy"),
    )
    intent = (
        F.when(F.size("sectors") > 0, "sector_search").when(F.size("tickers") > 0, "ticker_lookup")
        .when(F.col("_newsy"), "news_search").otherwise("general_search")
    )
    return parsed.select("query_id", "raw_query", intent.alias("intent"), "sectors", "tickers", "keywords")


def keyword_condition(query: str) -> Column | None:
    """Any word of three or more characters occurs in title or content, taken literally."""
    found = None
    for w in (w for w in query.lower().split() if len(w) > 2):
        hit = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(w)) | F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(w))
        found = hit if found is None else found | hit
    return found


def keyword_search(articles: DataFrame, query: str, k: int = vocab.SEARCH_SIZE) -> DataFrame:
    """Newest articles, one per URL, that contain any word of the query."""
    condition = keyword_condition(query)
    return topk.latest_per_url(articles.filter(F.lit(False) if condition is None else condition), k)


def keyword_search_batch(queries: DataFrame, articles: DataFrame, k: int = vocab.SEARCH_SIZE) -> DataFrame:
    """`keyword_search` for a table (query_id, raw_query).

    Neither words nor articles pass the driver.  A word has no white space, so it
    occurs in a text where one of the text's tokens holds it: tokens are reduced
    to one row per URL, joined to the words they hold, and each word is cut to
    the rows that can matter before it meets the queries that ask for it.
    """
    words = kept.query_words(queries)
    body = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    base = articles.select("id", "source", "title", "url", "timestamp", F.explode(F.array_distinct(F.split(body, r"(?U)\s+"))).alias("token"))
    held = durable(kept.holding(base.select("token"), words.select("word").distinct()))
    hits = first_per_key(base.join(held.select("token").distinct(), "token", "left_semi"), F.struct("token", "url"), ["id", "timestamp"], latest=True)
    latest = first_per_key(hits.join(held, "token").drop("token"), F.struct("word", "url"), ["id", "timestamp"], latest=True)
    asked = words.groupBy("query_id").agg(F.collect_set("word").alias("_asked")).select("query_id", "_asked", F.explode("_asked").alias("word"))
    met = kept.useful(latest, "word", k, asked.select("_asked").distinct()).join(asked, "word").filter(~F.arrays_overlap("_beaten", "_asked"))
    news = topk.latest_per_url(met.drop("word", "_asked", "_beaten"), k, ["query_id"])
    return news.select("query_id", "id", "source", "title", "url", "timestamp")


def partial_ticker_match(tickers: DataFrame, terms: DataFrame, limit: int = vocab.PARTIAL_MATCHES_PER_TERM) -> DataFrame:
    """Tickers whose symbol or company name contains a term, at most `limit` per term.

    terms: query_id, pos, term.  A term meets the tickers through its leading
    one to three letters, an equality join in place of a containment join.
    """
    def grams(c: str) -> Column:
        s = F.lower(F.coalesce(c, F.lit("")))
        starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(s, i, F.lit(n)) for n in (1, 2, 3)])))

    index = tickers.select(
        "symbol", "sector", "company_name", F.explode(F.array_distinct(F.concat(grams("symbol"), grams("company_name")))).alias("gram")
    )
    wanted = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct().withColumn(
        "gram", F.substring("term", 1, 3))
    met = wanted.join(index, "gram").filter(
        F.contains(F.lower("symbol"), F.col("term")) | F.contains(F.lower(F.coalesce("company_name", F.lit(""))), F.col("term"))
    )
    best = topk.top_per_group(met.drop("gram"), ["term"], [F.asc("symbol")], limit)
    joined = terms.select("query_id", "pos", F.lower("term").alias("term")).join(best, "term")
    unique = first_per_key(joined, F.struct("query_id", "symbol"), ["pos"])
    return unique.select("query_id", "pos", "symbol", "company_name", "sector",
                         F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("mentions_24h"),
                         F.lit(None).cast("double").alias("sentiment"))


def _ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return topk.top_per_group(df, ["query_id"], order, n, "rank")


def _news_for_symbols(wanted: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """Latest unique articles per query for its (query_id, symbol) rows.

    Queries that ask for the same symbols share one computation, and each
    symbol brings only the rows that can matter.
    """
    sets = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    members = sets.select("symbols").distinct().select("symbols", F.explode("symbols").alias("symbol"))
    rows = facts.join(members.select(F.col("symbol").alias("ticker")).distinct(), "ticker", "left_semi").select(
        F.col("ticker").alias("symbol"), F.col("article_id").alias("id"), "source", "title", "url", "timestamp", "sentiment"
    )
    latest = first_per_key(rows, F.struct("symbol", "url"), ["id", "timestamp", "sentiment"], latest=True)
    useful = kept.useful(latest, "symbol", k, members.select(F.col("symbols").alias("_asked")).distinct())
    met = useful.join(members, "symbol").filter(~F.arrays_overlap("_beaten", "symbols"))
    news = topk.latest_per_url(met.drop("symbol", "_beaten"), k, ["symbols"])
    return sets.join(news, "symbols").drop("symbols").withColumn("sentiment", scores.round4("sentiment"))


def search(queries: DataFrame, tickers: DataFrame, articles: DataFrame, mentions: DataFrame, as_of: dt.datetime,
           mode: str = "substring", k: int = vocab.SEARCH_SIZE, store_path: str | None = None) -> SearchResult:
    """Answer a table of queries (query_id, query, optional embedding).

    Sector and ticker questions return the best tickers of the sector or list;
    anything else looks for the nearest articles, or for matching keywords where
    the query or all articles have no vector, and derives tickers from them.
    With `store_path`, a store that keeps postings, keywords are looked up there
    and the texts are not read.

    What several results share (classified queries, ticker scores, matched
    articles, chosen tickers) is computed once and kept on shared storage.
    """
    facts = fx.mention_facts(mentions, articles)
    intents = durable(classify_queries(queries, mode))
    scored = durable(fx.ticker_scores(tickers, facts, as_of))
    by_score = [F.desc("score"), F.asc("symbol")]

    # sector questions: the best of each named sector, sectors in query order
    sector_best = topk.top_per_group(scored.filter("sector is not null"), ["sector"], by_score, k)
    asked = intents.filter("intent = 'sector_search'").select("query_id", F.posexplode("sectors").alias("pos", "sector"))
    from_sector = asked.join(sector_best, "sector")

    # ticker questions: known symbols, else partial matches
    named = intents.filter("intent = 'ticker_lookup'").select("query_id", F.posexplode("tickers").alias("pos", "symbol"))
    exact = topk.top_per_group(named.drop("pos").join(scored, "symbol"), ["query_id"], by_score, k)
    missed = named.join(exact.select("query_id").distinct(), "query_id", "left_anti")

    # everything else: nearest or matching articles
    loose = intents.filter("intent in ('news_search', 'general_search')")
    by_words = loose.select("query_id", "raw_query")
    cols_found = ["query_id", "id", "source", "title", "url", "timestamp", "rank"]
    near = None
    if "embedding" in articles.columns and "embedding" in queries.columns:
        held = articles.filter(F.col("embedding").isNotNull())
        if not held.isEmpty():
            vectors = queries.filter(F.col("embedding").isNotNull()).join(loose.select("query_id"), "query_id", "left_semi").select("query_id", "embedding")
            ranked = knn(vectors, held.select("id", "url", "embedding"), k).select("query_id", "id", "rank")
            near = ranked.join(articles.select("id", "source", "title", "url", "timestamp"), "id").select(cols_found)
            by_words = by_words.join(vectors.select("query_id"), "query_id", "left_anti")
    found = near
    if near is None or not by_words.isEmpty():
        matched = kept.search(queries.sparkSession, by_words, store_path, articles, k) if store_path else keyword_search_batch(by_words, articles, k)
        worded = _ranked(matched, [F.desc("timestamp"), F.desc("id")], k).select(cols_found)
        found = worded if near is None else near.unionByName(worded)
    found = durable(found)
    mentioned = mentions.join(found.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi")
    sentiment = fx.article_sentiment(mentioned).select(
        F.col("article_id").alias("id"), scores.round4("sentiment").alias("sentiment"))
    found_news = found.join(sentiment, "id", "left")
    related = durable(
        found.select("query_id", F.col("id").alias("article_id"))
        .join(mentions.select("article_id", F.col("ticker").alias("symbol")), "article_id")
        .select("query_id", "symbol").distinct()
    )
    from_articles = topk.top_per_group(related.join(scored, "symbol"), ["query_id"], by_score, k)
    empty = loose.join(found.select("query_id").distinct(), "query_id", "left_anti")

    # partial matches for questions that found nothing
    terms = missed.select("query_id", "pos", F.col("symbol").alias("term")).unionByName(
        empty.select("query_id", F.posexplode("keywords").alias("pos", "term")))
    partial = partial_ticker_match(tickers, terms)

    cols = ["query_id", "pos", "symbol", "company_name", "sector", "score", "mentions_24h", "sentiment"]
    flat = (
        from_sector.select(cols)
        .unionByName(exact.withColumn("pos", F.lit(0)).select(cols))
        .unionByName(from_articles.withColumn("pos", F.lit(0)).select(cols))
        .unionByName(partial.select(cols))
    )
    flat = durable(flat)
    best = _ranked(flat, [F.asc("pos"), *by_score], k).drop("pos")

    # news and trends of ticker-first questions use every ticker found, before the cut
    lookups = intents.filter("intent in ('sector_search', 'ticker_lookup')").select("query_id")
    chosen = flat.join(lookups, "query_id", "left_semi").select("query_id", "symbol")
    news_cols = ["query_id", "rank", "id", "source", "title", "url", "timestamp", "sentiment"]
    ticker_news = _ranked(_news_for_symbols(chosen, facts, k), [F.desc("timestamp"), F.desc("id")], k)
    news = ticker_news.select(news_cols).unionByName(found_news.select(news_cols))

    wanted = chosen.unionByName(related)
    trend = fx.trend_data(wanted, facts, as_of)
    trends = _ranked(wanted.join(trend, "symbol"), by_score, k).select(
        "query_id", "rank", "symbol", "mentions_1h", "mentions_24h", "sentiment", "score", "spike")
    return SearchResult(intents, best.select("query_id", "rank", *cols[2:]), news, trends)
