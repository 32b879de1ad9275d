"""Domain tables derived from the supplied parquet tables.

`events` are read as published articles, `user_id` as tickers and `part` names
as company names; `raw_*` render the same events as the payloads of each
source.  `catalog.py` states the same derivations in SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions import times
from tidewatch.operators import facts as fx
from tidewatch.streaming import jobs

SOURCES = (
    "alphavantage", "polygon", "finnhub_general", "finnhub_company", "finnhub_insider", "yahoo_rss",
    "newsapi", "googlenews_rss", "gdelt", "stocktwits", "twitter", "reddit",
)
WEIGHTS_E2 = (100, 90, 90, 90, 90, 85, 80, 80, 75, 30, 30, 20)
SECTORS = (
    "Industrials", "Financials", "Technology", "Healthcare", "Consumer Discretionary", "Consumer Staples",
    "Utilities", "Real Estate", "Materials", "Communication Services", "Energy",
)
SECTOR_QUERIES = ("AI", "oil", "bank", "retail", "pharma", "utilities", "mining", "media", "reit", "tech chip")


def symbol(user: Column | str) -> Column:
    """User number as letters A-J, at least four of them."""
    u = (F.col(user) if isinstance(user, str) else user).cast("string")
    padded = F.when(F.length(u) < 4, F.lpad(u, 4, "0")).otherwise(u)
    return F.translate(padded, "0123456789", "ABCDEFGHIJ")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


class Views:
    """Lazily built tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = session.tune(spark), sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def _extremes(self) -> tuple[dt.datetime, int]:
        """Newest event time and highest user; one aggregate over two columns."""
        return tuple(self.table("events").agg(F.max(F.col("ts").cast("timestamp_ntz")), F.max("user_id")).first())

    @property
    def as_of(self) -> dt.datetime:
        return self._extremes[0]

    @property
    def max_user(self) -> int:
        return self._extremes[1]

    @cached_property
    def tickers(self) -> DataFrame:
        users = self.table("events").select("user_id").distinct()
        part = self.table("part").select(F.col("p_partkey").alias("user_id"), "p_name")
        sector = F.when(F.col("user_id") % 23 != 0, pick(SECTORS, F.col("user_id") % 11))
        return users.join(part, "user_id", "left").select(
            symbol("user_id").alias("symbol"), sector.alias("sector"), F.col("p_name").alias("company_name")
        )

    @cached_property
    def plain_events(self) -> DataFrame:
        """Events with the ticker and source they stand for."""
        return self.table("events").withColumn("sym", symbol("user_id")).withColumn(
            "source", pick(SOURCES, F.col("event_id") % 12))

    @cached_property
    def events(self) -> DataFrame:
        """Events that also carry the company name, spread over the cores for text work."""
        part = self.table("part").select(F.col("p_partkey").alias("user_id"), "p_name")
        return session.spread(self.plain_events).join(part, "user_id", "left")

    @staticmethod
    def _article_columns() -> list[Column]:
        url = F.concat(F.lit("https://example.com/"), "sym", F.lit("/"), (F.col("event_id") % 50).cast("string"))
        return [
            F.col("event_id").alias("id"), F.col("source"), url.alias("url"), F.col("ts").alias("timestamp"),
            F.to_date("ts").alias("dt"),
        ]

    @cached_property
    def headers(self) -> DataFrame:
        """Articles without their text."""
        return self.plain_events.select(*self._article_columns())

    @cached_property
    def articles(self) -> DataFrame:
        return self.events.select(
            *self._article_columns(),
            F.concat_ws(" ", "sym", "p_name", "event_type", F.lit("-"), "source").alias("title"),
            F.concat_ws(" ", "sym", "event_type", "p_name", "props").alias("content"),
            (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("created_at"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """One mention of the event's ticker; every third event also mentions the next ticker."""
        e = F.col("event_id")
        units = F.greatest(F.lit(-10000), F.least(F.lit(10000), F.round((F.col("value") - 50) * 100).cast("bigint")))
        sentiment = F.when(e % 17 != 0, units / F.lit(10000.0))
        own = F.struct((e * 2).alias("id"), symbol("user_id").alias("ticker"), sentiment.alias("sentiment"))
        neighbour = symbol((F.col("user_id") + 1) % (self.max_user + 1))
        other = F.struct((e * 2 + 1).alias("id"), neighbour.alias("ticker"), (-sentiment).alias("sentiment"))
        rows = self.table("events").select(
            e.alias("article_id"), F.col("ts").alias("created_at"), F.to_date("ts").alias("dt"),
            (pick(WEIGHTS_E2, e % 12) / F.lit(100.0)).alias("source_weight"),
            F.explode(F.when(e % 3 == 0, F.array(own, other)).otherwise(F.array(own))).alias("m"),
        ).select("m.*", "article_id", "source_weight", "created_at", "dt")
        known = self.tickers.select(F.col("symbol").alias("ticker"))
        return rows.join(known, "ticker", "left_semi")

    @cached_property
    def facts(self) -> DataFrame:
        """Mentions with their article's header; both sides carry its date, as in the store."""
        return fx.mention_facts(self.mentions, self.headers)

    @cached_property
    def titled_facts(self) -> DataFrame:
        return fx.mention_facts(self.mentions, self.articles)

    @cached_property
    def query_log(self) -> DataFrame:
        """Distinct search texts of the log, one logged search per event."""
        e = F.col("event_id")
        following = symbol((F.col("user_id") + 1) % (self.max_user + 1))
        text = (
            F.when(e % 7 == 0, F.concat(pick(SECTOR_QUERIES, F.col("user_id") % 10), F.lit(" stocks")))
            .when(e % 7 == 1, F.concat(F.lit("$"), "sym"))
            .when(e % 7 == 2, F.concat_ws(" ", "sym", F.lit("or"), following))
            .when(e % 7 == 3, F.concat_ws(" ", "p_name", F.lit("earnings")))
            .when(e % 7 == 4, F.col("p_name"))
            .when(e % 7 == 5, F.upper(F.substring("p_name", 1, 3)))
            .otherwise(F.concat_ws(" ", F.lit("latest news on"), "p_name"))
        )
        return self.events.select(text.alias("query")).filter("query is not null").distinct().select(
            F.col("query").alias("query_id"), "query"
        )

    # Raw payloads, one per event of a source

    def of_source(self, source: str) -> DataFrame:
        return self.events.filter(F.col("source") == source)

    def _iso(self) -> Column:
        return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def _stamp(self, pattern: str, broken: bool = True) -> Column:
        """Formatted event time; every seventh is missing, every eleventh unreadable."""
        e, good = F.col("event_id"), F.date_format("ts", pattern)
        readable = F.when(e % 11 == 0, F.lit("soon")).otherwise(good) if broken else good
        return F.when(e % 7 != 0, readable)

    def _epoch(self) -> Column:
        return F.when(F.col("event_id") % 7 != 0, F.unix_seconds(F.col("ts").cast("timestamp")))

    @staticmethod
    def _url() -> Column:
        return F.concat(F.lit("https://example.com/"), "sym", F.lit("/"), F.col("event_id").cast("string"))

    @staticmethod
    def _headline() -> Column:
        return F.concat_ws(" ", "sym", "p_name", "event_type")

    def _json(self, source: str, **fields: Column) -> DataFrame:
        rows = self.of_source(source)
        return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))

    def raw_newsapi(self) -> DataFrame:
        e = F.col("event_id")
        return self._json(
            "newsapi", publishedAt=self._stamp("yyyy-MM-dd'T'HH:mm:ss'Z'", False), title=F.when(e % 5 != 0, self._headline()),
            content=F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, F.lit("")),
            description=F.when(e % 4 != 0, F.col("event_type")), url=F.when(e % 9 != 0, self._url()),
        )

    def raw_alphavantage(self) -> DataFrame:
        e = F.col("event_id")
        score = F.when(e % 4 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("0."), (e % 9 + 1).cast("string")))
        rated = F.array(
            F.struct(F.lower("sym").alias("ticker"), score.alias("ticker_sentiment_score")),
            F.struct(F.lit("ZZZZ").alias("ticker"), F.lit("0.5").alias("ticker_sentiment_score")),
        )
        return self._json(
            "alphavantage", title=self._headline(), summary=F.when(e % 3 != 0, F.col("props")), url=self._url(),
            time_published=self._stamp("yyyyMMdd'T'HHmmss"), overall_sentiment_score=score, ticker_sentiment=rated,
        )

    def raw_polygon(self) -> DataFrame:
        e = F.col("event_id")
        return self._json(
            "polygon", id=e.cast("string"), published_utc=self._stamp("yyyy-MM-dd'T'HH:mm:ss'Z'", False),
            title=self._headline(), description=F.when(e % 3 != 0, F.col("props")), article_url=self._url(),
            tickers=F.when(e % 5 != 0, F.array(F.lower("sym"), F.lit("zzzz"))),
        )

    def raw_tweets(self) -> DataFrame:
        """Every tweet twice, as two searches of one run return it."""
        e = F.col("event_id")
        once = self._json("twitter", id=e.cast("string"), text=F.concat(F.lit("$"), self._headline()), created_at=self._iso())
        return once.unionByName(once)

    def raw_reddit(self) -> DataFrame:
        e = F.col("event_id")
        return self._json(
            "reddit", id=e.cast("string"), title=self._headline(), selftext=F.when(e % 2 == 0, F.col("props")).otherwise(""),
            created_utc=self._epoch().cast("double"), permalink=F.concat(F.lit("/r/stocks/"), e.cast("string")),
        )

    def _finnhub(self, source: str, **more: Column) -> DataFrame:
        e = F.col("event_id")
        return self._json(
            source, headline=F.when(e % 5 != 0, self._headline()), summary=F.when(e % 3 != 0, F.col("props")),
            url=F.when(e % 9 != 0, self._url()).otherwise(""), datetime=self._epoch().cast("string"), **more,
        )

    def raw_finnhub_general(self) -> DataFrame:
        e = F.col("event_id")
        return self._finnhub(
            "finnhub_general", related=F.when(e % 4 == 0, F.concat_ws(" ,", F.lower("sym"), F.lit("ZZZZ"), F.lit("AAAB"))))

    def raw_finnhub_company(self) -> DataFrame:
        return self._finnhub("finnhub_company", symbol=F.col("sym"))

    def raw_insider(self) -> DataFrame:
        e = F.col("event_id")
        return self._json(
            "finnhub_insider", symbol=F.col("sym"), mspr=F.when(e % 19 != 0, (e % 501 - 250) / F.lit(200.0)),
            change=F.when(e % 5 != 0, e * 7 - 5000), year=F.lit(2024), month=F.when(e % 13 != 0, e % 13),
        )

    def raw_stocktwits(self) -> DataFrame:
        e = F.col("event_id")
        tag = F.when(F.col("event_type") == "purchase", "Bullish").when(F.col("event_type") == "error", "Bearish")
        entities = F.struct(F.when(e % 2 == 0, F.struct(tag.alias("basic"))).alias("sentiment"))
        return self._json(
            "stocktwits", id=F.when(e % 31 != 0, e.cast("string")), body=F.concat(F.lit("  "), self._headline(), F.lit(" ")),
            created_at=self._stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), symbol=F.col("sym"), pos=(e % 40), entities=entities,
        )

    def raw_rss(self, source: str) -> DataFrame:
        """One feed document per event, with up to 19 items; every fifth item has no link."""
        e = F.col("event_id")
        stamp = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")

        def item(i: Column) -> Column:
            link = F.when(i % 5 != 4, F.concat(self._url(), F.lit("/"), i.cast("string"))).otherwise("")
            body = F.when(i % 3 == 0, F.lit("")).otherwise(F.col("event_type"))
            date = F.when(i % 2 == 0, F.concat(F.lit("<pubDate>"), stamp, F.lit(" GMT</pubDate>"))).otherwise("")
            return F.concat(
                F.lit("<item><title> "), self._headline(), F.lit(" "), i.cast("string"), F.lit(" - Wire</title><link>"), link,
                F.lit("</link><description>"), body, F.lit("</description>"), date,
                F.lit('<source url="http://wire.example.com">Wire</source></item>'),
            )

        items = F.when(e % 20 > 0, F.transform(F.sequence(F.lit(0), (e % 20 - 1).cast("int")), item)).otherwise(F.array())
        xml = F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(items, ""), F.lit("</channel></rss>"))
        broken = F.when(e % 29 == 0, F.lit("<rss><chan")).otherwise(xml)
        return self.of_source(source).select(F.col("sym").alias("feed"), broken.alias("xml"))

    def raw_gkg(self) -> DataFrame:
        """One GKG line per event; every thirteenth is cut short."""
        e, kind = F.col("event_id"), F.col("event_type")
        v2 = (
            F.when(kind == "purchase", F.lit("TAX_A,1;ECON_STOCKMARKET_IPO,22")).when(kind == "error", F.lit("BUS_LAYOFFS,3"))
            .when(kind == "view", F.lit("WB_1,2;XECON_TRADE,5")).otherwise(F.lit(""))
        )
        v1 = F.when(kind == "view", F.lit("ECON_TRADE;B")).otherwise(F.lit("A;XBUS_IPO"))
        quotes = F.when(e % 3 == 0, F.concat(F.lit("1,2,Ann, \""), "p_name", F.lit(", yes\" |bad|3,4,Bob,|5,6,Cy,more|7,8,Di,x|9,9,Ed,y"))).otherwise("")
        extras = F.when(e % 4 != 0, F.concat(F.lit("<A>1</A><PAGE_TITLE> "), self._headline(), F.lit(" </PAGE_TITLE>"))).otherwise("<PAGE_TITLE> </PAGE_TITLE>")
        link = F.when(e % 10 == 0, F.lit("ftp://example.com/x")).otherwise(F.concat(F.lit(" "), self._url()))
        cells = {1: F.date_format("ts", "yyyyMMddHHmmss"), 4: link, 7: v1, 8: v2, 22: quotes, 26: extras}
        wide = F.array(*[cells.get(i, F.lit("")) for i in range(27)])
        line = F.array_join(F.when(e % 13 == 0, F.slice(wide, 1, 20)).otherwise(wide), "\t")
        return self.events.select(line.alias("value"))

    def responses(self) -> DataFrame:
        """Scorer answers: fenced, embedded, plain, unusable, incomplete, out of range."""
        e = F.col("event_id")
        digits = F.lpad((e * 37 % 10000).cast("string"), 4, "0")
        number = F.concat(F.when(e % 2 == 0, F.lit("-")).otherwise(""), F.when(e % 6 == 5, F.lit("3.")).otherwise("0."), digits)
        doc = F.concat(
            F.lit('{"ticker": "'), "sym", F.lit('", "is_relevant": '), F.when(e % 5 == 0, F.lit("false")).otherwise("true"),
            F.lit(', "sentiment": '), number, F.lit(', "summary": "'), "event_type", F.lit('"}'),
        )
        text = (
            F.when(e % 6 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
            .when(e % 6 == 1, F.concat(F.lit("Sure: "), doc, F.lit(" Done.")))
            .when(e % 6 == 3, F.lit("no answer"))
            .when(e % 6 == 4, F.concat(F.lit('{"ticker": "'), "sym", F.lit('"}')))
            .otherwise(doc)
        )
        return self.events.select("event_id", text.alias("response"))

    # Streams

    def event_stream(self, name: str = "events", order: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
        """A table as a stream of several micro-batches: its thirds by id arrive one after the other, in the given order.

        Rows without an id, or with a negative one, come in the first third; an
        empty table is one of empty micro-batches.  Each third is written by
        several tasks, equally many files each, if it has the rows for it.
        """
        key, arrivals = {"events": "event_id", "documents": "doc_id"}[name], session.scratch_path(self.spark, "arrivals")
        table = self.table(name)
        end = max(table.agg(F.max(key)).first()[0] or 0, 0) + 1
        parts = table.withColumn("_third", F.greatest(F.lit(0), F.coalesce(F.floor(F.col(key) * 3 / F.lit(end)), F.lit(0))))
        rows = dict(parts.groupBy("_third").count().collect())
        files = max(1, min(table.rdd.getNumPartitions(), min(rows.get(i, 0) for i in order) // 10_000))
        for third in order:
            parts.filter(F.col("_third") == third).drop("_third").repartition(files).write.mode("append").parquet(arrivals)
        return jobs.stream_files(self.spark, arrivals, table.schema, files_per_trigger=files)
