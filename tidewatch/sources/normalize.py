"""JSON sources -> NormalizedItem.

Each normaliser is a projection over parsed payloads; `read_records` parses
JSON text, one document per row.  `ingested_at` stands in for a missing
publication time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import scores, text, times, vocab
from ..operators.dedup import first_per_key
from ..operators.filters import known_tickers


def read_records(source: DataFrame | str, record: T.StructType, spark: SparkSession | None = None) -> DataFrame:
    """Payload rows from JSON text: a path, or a DataFrame with a `value` column.

    Unreadable documents become rows of NULLs, which the normalisers drop or default.
    """
    if isinstance(source, str):
        return spark.read.schema(record).json(source)
    keep = [c for c in source.columns if c != "value"]
    return source.select(*keep, F.from_json("value", record).alias("_r")).select(*keep, "_r.*")


def _now(ingested_at: dt.datetime) -> Column:
    return F.lit(times.utc(ingested_at).isoformat(sep=" ") + "+00:00").cast("timestamp")


def _filled(*columns: str) -> Column:
    """First non-empty text, else empty."""
    return F.coalesce(*[text.blank_to_null(c) for c in columns], F.lit(""))


def _no_tickers() -> Column:
    return F.array().cast("array<string>")


def _upper(tickers: Column | str) -> Column:
    named = F.filter(tickers, lambda t: t.isNotNull())
    return F.coalesce(F.transform(named, F.upper), _no_tickers())


def _items(raw: DataFrame, *extra: Column, **fields: Column) -> DataFrame:
    cols = []
    for f in schema.NORMALIZED_ITEM.fields:
        value = fields.get(f.name, F.lit(None))
        cols.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*cols, *extra)


def normalize_newsapi(raw: DataFrame, ingested_at: dt.datetime, strict: bool = True) -> DataFrame:
    return _items(
        raw,
        id=text.stable_id("newsapi", F.coalesce("url", F.lit("")), _filled("title"), F.coalesce("publishedAt", F.lit(""))),
        source=F.lit("newsapi"),
        title=_filled("title"),
        content=_filled("content", "description"),
        timestamp=times.parse_source_ts("publishedAt", "iso", _now(ingested_at), strict),
        url=F.col("url"),
        tickers=_no_tickers(),
    )


def normalize_alphavantage(raw: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    """Also carries `provider_scores`, the provider's own per-ticker sentiment."""
    rated = F.filter("ticker_sentiment", lambda t: t["ticker"].isNotNull())
    provider = F.transform(
        rated, lambda t: F.struct(F.upper(t["ticker"]).alias("ticker"), t["ticker_sentiment_score"].alias("score"))
    )
    return _items(
        raw, provider.alias("provider_scores"),
        id=F.concat(F.lit("alphavantage-"), _filled("url")),
        source=F.lit("alphavantage"),
        title=_filled("title"),
        content=_filled("summary", "title"),
        timestamp=times.parse_source_ts("time_published", "compact", _now(ingested_at)),
        url=text.blank_to_null("url"),
        tickers=_upper(F.col("ticker_sentiment.ticker")),
        sentiment=F.col("overall_sentiment_score").try_cast("double"),
    )


def normalize_polygon(raw: DataFrame, ingested_at: dt.datetime, strict: bool = True) -> DataFrame:
    return _items(
        raw,
        id=F.concat(F.lit("polygon-"), F.col("id")),
        source=F.lit("polygon"),
        title=_filled("title"),
        content=_filled("description", "title"),
        timestamp=times.parse_source_ts("published_utc", "iso", _now(ingested_at), strict),
        url=F.col("article_url"),
        tickers=_upper("tickers"),
    )


def normalize_tweets(raw: DataFrame, ingested_at: dt.datetime, strict: bool = True) -> DataFrame:
    """One row per tweet id."""
    unique = first_per_key(raw.filter(F.col("id").isNotNull()), "id", ["created_at", "text"])
    return _items(
        unique,
        id=F.concat(F.lit("twitter-"), F.col("id")),
        source=F.lit("twitter"),
        content=F.coalesce("text", F.lit("")),
        timestamp=times.parse_source_ts("created_at", "iso", _now(ingested_at), strict),
        url=F.concat(F.lit("https://twitter.com/i/web/status/"), F.col("id")),
        tickers=_no_tickers(),
    )


def normalize_reddit(raw: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    return _items(
        raw,
        id=F.concat(F.lit("reddit-"), F.col("id")),
        source=F.lit("reddit"),
        title=F.col("title"),
        content=_filled("selftext", "title"),
        timestamp=times.parse_source_ts("created_utc", "unix", _now(ingested_at)),
        url=F.concat(F.lit("https://reddit.com"), F.col("permalink")),
        tickers=_no_tickers(),
    )


def _finnhub(raw: DataFrame, ingested_at: dt.datetime, source: str, item_id: Column, tickers: Column) -> DataFrame:
    return _items(
        raw,
        id=item_id,
        source=F.lit(source),
        title=text.blank_to_null("headline"),
        content=_filled("summary", "headline"),
        timestamp=times.parse_source_ts("datetime", "unix", _now(ingested_at)),
        url=text.blank_to_null("url"),
        tickers=tickers,
    )


def normalize_finnhub_general(raw: DataFrame, tickers: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    """`related` names tickers; only known ones stay."""
    related = F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda s: F.upper(text.strip(s)))
    named = _finnhub(raw, ingested_at, "finnhub_general", F.concat(F.lit("finnhub-general-"), _filled("url")), related)
    return known_tickers(named, tickers)


def normalize_finnhub_company(raw: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    """News requested for one `symbol`."""
    item_id = F.concat(F.lit("finnhub-company-"), F.col("symbol"), F.lit("-"), _filled("url"))
    return _finnhub(raw, ingested_at, "finnhub_company", item_id, F.array("symbol"))


def normalize_insider(raw: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    """One synthetic item per symbol and month of insider trading."""
    usable = raw.filter(F.col("mspr").isNotNull())
    dated = (F.coalesce("year", F.lit(0)) != 0) & (F.coalesce("month", F.lit(0)) != 0)
    period = F.when(dated, F.format_string("%d-%02d", "year", "month")).otherwise(F.lit("unknown"))
    direction = F.when(F.col("mspr") >= 0, "buying").otherwise("selling")
    shares = F.abs(F.coalesce(F.col("change").cast("bigint"), F.lit(0)))
    title = F.format_string(
        "%s insiders net %s %,d shares (MSPR %+.3f) — %s", F.col("symbol"), direction, shares, F.col("mspr"), period
    )
    return _items(
        usable,
        id=F.concat_ws("-", F.lit("finnhub-insider"), "symbol", period),
        source=F.lit("finnhub_insider"),
        title=title,
        content=title,
        timestamp=_now(ingested_at),
        url=F.concat(F.lit("finnhub://insider-sentiment/"), F.col("symbol"), F.lit("/"), period),
        tickers=F.array("symbol"),
        sentiment=scores.clamp_unit("mspr"),
    )


def normalize_stocktwits(raw: DataFrame, ingested_at: dt.datetime, per_symbol: int | None = None) -> DataFrame:
    """Messages of each symbol's stream, with the author's tag as sentiment; `per_symbol` keeps the first (`pos` counts from 0)."""
    page = raw if per_symbol is None else raw.filter(F.col("pos") < per_symbol)
    body = text.strip(F.coalesce("body", F.lit("")))
    usable = page.filter((F.coalesce("id", F.lit("")) != "") & (body != ""))
    tag = F.coalesce(F.col("entities.sentiment.basic"), F.col("entities.basic"))
    return _items(
        usable,
        id=F.concat(F.lit("stocktwits-"), F.col("id")),
        source=F.lit("stocktwits"),
        content=body,
        timestamp=times.parse_source_ts("created_at", "zulu", _now(ingested_at)),
        url=F.concat(F.lit("https://stocktwits.com/message/"), F.col("id")),
        tickers=F.array("symbol"),
        sentiment=scores.lookup(tag, vocab.MESSAGE_TAGS, F.lit(0.0)),
    )


def prefer_provider_score(mentions: DataFrame) -> DataFrame:
    """Mention sentiment replaced by the provider's score for that ticker where it is a number."""
    own = F.filter("provider_scores", lambda p: p["ticker"] == F.col("ticker"))
    score = F.get(own, F.lit(0))["score"].try_cast("double")
    return mentions.withColumn("sentiment", F.coalesce(score, F.col("sentiment")))
