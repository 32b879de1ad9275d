"""RSS feeds and GKG snapshots -> NormalizedItem."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times, vocab
from .normalize import _filled, _items, _no_tickers, _now

_ITEM = "title: STRING, link: STRING, description: STRING, pubDate: STRING, source: STRUCT<_VALUE: STRING, _url: STRING>"
RSS = f"channel STRUCT<item: ARRAY<STRUCT<{_ITEM}>>>"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed document: `feed` (file stem) and `xml`."""
    docs = spark.read.option("wholetext", True).text(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return docs.select(F.url_decode(stem).alias("feed"), F.col("value").alias("xml"))


def rss_items(feeds: DataFrame, per_feed: int | None = None) -> DataFrame:
    """Items of feed documents in feed order; unreadable documents give none.

    `per_feed` keeps the first items of each feed; it counts those without a link,
    which are dropped.
    """
    parsed = feeds.select("feed", F.from_xml("xml", RSS).alias("doc"))
    spread = parsed.select("feed", F.posexplode("doc.channel.item").alias("pos", "item"))
    if per_feed is not None:
        spread = spread.filter(F.col("pos") < per_feed)
    trimmed = spread.select(
        "feed", "pos",
        text.strip(F.coalesce("item.title", F.lit(""))).alias("title"),
        text.strip(F.coalesce("item.link", F.lit(""))).alias("link"),
        text.strip(_filled("item.description", "item.title")).alias("description"),
        text.blank_to_null(text.strip("item.pubDate")).alias("published"),
        text.strip(F.coalesce("item.source._VALUE", F.lit(""))).alias("publisher"),
    )
    return trimmed.filter(F.col("link") != "")


def normalize_yahoo_rss(feeds: DataFrame, ingested_at: dt.datetime,
                        per_feed: int | None = None) -> DataFrame:
    """Per-ticker feeds: the feed name is the ticker."""
    return _items(
        rss_items(feeds, per_feed),
        id=F.concat_ws("-", F.lit("yahoo"), "feed", "link"),
        source=F.lit("yahoo_rss"),
        title=text.blank_to_null("title"),
        content=F.col("description"),
        timestamp=times.parse_source_ts("published", "rfc2822", _now(ingested_at)),
        url=F.col("link"),
        tickers=F.array("feed"),
    )


def normalize_google_rss(feeds: DataFrame, ingested_at: dt.datetime,
                         per_feed: int | None = None) -> DataFrame:
    """Per-query feeds: adds the publisher and the outlet-free text to fingerprint."""
    return _items(
        rss_items(feeds, per_feed), F.col("publisher"), text.fingerprint_title("title").alias("fingerprint"),
        id=text.stable_id("googlenews", "feed", "link"),
        source=F.lit("googlenews_rss"),
        title=text.blank_to_null("title"),
        content=F.col("description"),
        timestamp=times.parse_source_ts("published", "rfc2822", _now(ingested_at)),
        url=F.col("link"),
        tickers=_no_tickers(),
    )


def gkg_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """GKG columns of interest; short rows are skipped.

    A generator hands on the cells: filters on them stay behind it, so a line is made and split once.
    """
    long_enough = F.filter(F.array(F.split(column, "\t", -1)), lambda c: F.size(c) >= vocab.GKG_MIN_COLUMNS)
    cells = lines.select(F.explode(long_enough).alias("c"))

    def cell(i: int) -> Column:
        return F.col("c")[i]

    return cells.select(
        cell(vocab.GKG_DATE).alias("date"), text.strip(cell(vocab.GKG_URL)).alias("url"),
        cell(vocab.GKG_THEMES_V1).alias("themes_v1"), cell(vocab.GKG_THEMES_V2).alias("themes_v2"),
        cell(vocab.GKG_QUOTATIONS).alias("quotations"), cell(vocab.GKG_EXTRAS).alias("extras"),
    )


def normalize_gdelt(rows: DataFrame, ingested_at: dt.datetime,
                    prefixes: tuple[str, ...] = vocab.FINANCE_THEMES) -> DataFrame:
    """Finance rows of a GKG snapshot: quoted text, else page title, else URL."""
    finance = rows.filter(text.theme_match("themes_v2", "themes_v1", prefixes) & F.col("url").startswith("http"))
    title = text.page_title("extras")
    return _items(
        finance,
        id=text.stable_id("gdelt", "url"),
        source=F.lit("gdelt"),
        title=title,
        content=F.coalesce(text.quotation_text("quotations"), title, F.col("url")),
        timestamp=times.parse_source_ts("date", "gkg", _now(ingested_at)),
        url=F.col("url"),
        tickers=_no_tickers(),
    )
