"""Source normalisers, URL rules and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema, session
from tidewatch.functions import scores, text, vocab
from tidewatch.operators import dedup, facts as fx, filters, models, setops, topk
from tidewatch.plans import ingest as ing
from tidewatch.sources import feeds, normalize, store, url_filter

from .catalog import inlist, query, r4, sym
from .texts import WALK, edges_sql, hashing_encoder
from .views import Views

NOW = "(select t from latest)"
URL = "concat('https://example.com/',sym,'/',event_id)"
HEAD = "concat_ws(' ',sym,p_name,event_type)"
ISO_TS = f"case when event_id%7=0 then {NOW} else date_trunc('second',ts) end"
TRY_TS = f"case when event_id%7=0 or event_id%11=0 then {NOW} else date_trunc('second',ts) end"


def flat(items: DataFrame) -> DataFrame:
    """Items with comparable columns: the time without zone, the tickers as text."""
    return items.select(
        "id", "source", "title", "content", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "url",
        F.array_join("tickers", ",").alias("tickers"), "sentiment")


def item_sql(source: str, id_: str, title: str, content: str, ts: str, url: str, tickers: str = "''",
             sentiment: str = "cast(null as double)", where: str = "true") -> str:
    return f"""select {id_} id, '{source}' source, {title} title, {content} as content, {ts} as "timestamp", {url} url,
      {tickers} tickers, {sentiment} sentiment from ev where source='{source}' and {where}"""


PARTS = {
    "newsapi": item_sql(
        "newsapi", "concat('newsapi-',substr(md5(concat_ws('||',coalesce(case when event_id%9<>0 then " + URL + " end,''),"
        "coalesce(case when event_id%5<>0 then " + HEAD + " end,''),coalesce(case when event_id%7<>0 then strftime(ts,'%Y-%m-%dT%H:%M:%SZ') end,''))),1,12))",
        f"case when event_id%5<>0 then {HEAD} else '' end",
        "case when event_id%3=0 then props when event_id%4<>0 then event_type else '' end",
        ISO_TS, f"case when event_id%9<>0 then {URL} end"),
    "alphavantage": item_sql(
        "alphavantage", f"concat('alphavantage-',{URL})", HEAD, f"case when event_id%3<>0 then props else {HEAD} end", TRY_TS, URL,
        "concat(sym,',ZZZZ')", "case when event_id%4<>0 then (event_id%9+1)/1e1 end"),
    "polygon": item_sql(
        "polygon", "concat('polygon-',event_id)", HEAD, f"case when event_id%3<>0 then props else {HEAD} end", ISO_TS, URL,
        "case when event_id%5<>0 then concat(sym,',ZZZZ') else '' end"),
    "twitter": item_sql(
        "twitter", "concat('twitter-',event_id)", "cast(null as varchar)", f"concat('$',{HEAD})", "date_trunc('second',ts)",
        "concat('https://twitter.com/i/web/status/',event_id)"),
    "reddit": item_sql(
        "reddit", "concat('reddit-',event_id)", HEAD, f"case when event_id%2=0 then props else {HEAD} end", ISO_TS,
        "concat('https://reddit.com/r/stocks/',event_id)"),
    "finnhub_company": item_sql(
        "finnhub_company", f"concat('finnhub-company-',sym,'-',case when event_id%9<>0 then {URL} else '' end)",
        f"case when event_id%5<>0 then {HEAD} end",
        f"case when event_id%3<>0 then props when event_id%5<>0 then {HEAD} else '' end", ISO_TS,
        f"case when event_id%9<>0 then {URL} end", "sym"),
    "finnhub_general": item_sql(
        "finnhub_general", f"concat('finnhub-general-',case when event_id%9<>0 then {URL} else '' end)",
        f"case when event_id%5<>0 then {HEAD} end",
        f"case when event_id%3<>0 then props when event_id%5<>0 then {HEAD} else '' end", ISO_TS,
        f"case when event_id%9<>0 then {URL} end", "case when event_id%4=0 then concat(sym,',AAAB') else '' end"),
    "finnhub_insider": (lambda period, title: item_sql(
        "finnhub_insider", f"concat('finnhub-insider-',sym,'-',{period})", title, title, NOW,
        f"concat('finnhub://insider-sentiment/',sym,'/',{period})", "sym",
        "greatest(-1e0,least(1e0,(event_id%501-250)/2e2))", "event_id%19<>0"))(
            "case when event_id%13<>0 then concat('2024-',lpad(cast(event_id%13 as varchar),2,'0')) else 'unknown' end",
            "concat(sym,' insiders net ',case when event_id%501>=250 then 'buying' else 'selling' end,' ',"
            "format('{:,}',abs(case when event_id%5<>0 then event_id*7-5000 else 0 end)),' shares (MSPR ',"
            "printf('%+.3f',(event_id%501-250)/2e2),') — ',case when event_id%13<>0 then concat('2024-',lpad(cast(event_id%13 as varchar),2,'0')) else 'unknown' end)"),
    "stocktwits": item_sql(
        "stocktwits", "concat('stocktwits-',event_id)", "cast(null as varchar)", HEAD, TRY_TS,
        "concat('https://stocktwits.com/message/',event_id)", "sym",
        "case when event_id%2=0 and event_type='purchase' then 1e0 when event_id%2=0 and event_type='error' then -1e0 else 0e0 end",
        "event_id%31<>0"),
}
RSS_ITEMS = """select *, unnest(range(event_id%20)) i from ev where event_id%29<>0"""


def rss_sql(source: str, id_: str, tickers: str) -> str:
    title = f"concat({HEAD},' ',i,' - Wire')"
    return f"""select {id_} id, '{source}' source, {title} title, case when i%3=0 then {title} else event_type end as content,
      case when i%2=0 then date_trunc('second',ts) else {NOW} end as "timestamp", concat({URL},'/',i) url, {tickers} tickers,
      cast(null as double) sentiment from ({RSS_ITEMS}) where source='{source}' and i%5<>4"""


PARTS["yahoo_rss"] = rss_sql("yahoo_rss", f"concat('yahoo-',sym,'-',{URL},'/',i)", "sym")
PARTS["googlenews_rss"] = rss_sql("googlenews_rss", f"concat('googlenews-',substr(md5(concat(sym,'||',{URL},'/',i)),1,12))", "''")
PARTS["gdelt"] = f"""select concat('gdelt-',substr(md5({URL}),1,12)) id, 'gdelt' source, case when event_id%4<>0 then {HEAD} end title,
   case when event_id%3=0 then concat('"',p_name,', yes" more x') when event_id%4<>0 then {HEAD} else {URL} end as content,
   date_trunc('second',ts) as "timestamp", {URL} url, '' tickers, cast(null as double) sentiment
 from ev where event_id%13<>0 and event_id%10<>0 and event_type in ('purchase','error','view')"""


def parse(v: Views, source: str) -> DataFrame:
    now = v.as_of
    read = normalize.read_records
    makers = {
        "newsapi": lambda: normalize.normalize_newsapi(read(v.raw_newsapi(), schema.NEWSAPI), now),
        "alphavantage": lambda: normalize.normalize_alphavantage(read(v.raw_alphavantage(), schema.ALPHAVANTAGE), now),
        "polygon": lambda: normalize.normalize_polygon(read(v.raw_polygon(), schema.POLYGON), now),
        "twitter": lambda: normalize.normalize_tweets(read(v.raw_tweets(), schema.TWEET), now),
        "reddit": lambda: normalize.normalize_reddit(read(v.raw_reddit(), schema.REDDIT), now),
        "finnhub_general": lambda: normalize.normalize_finnhub_general(
            read(v.raw_finnhub_general(), schema.FINNHUB_NEWS), v.tickers, now),
        "finnhub_company": lambda: normalize.normalize_finnhub_company(read(v.raw_finnhub_company(), schema.FINNHUB_NEWS), now),
        "finnhub_insider": lambda: normalize.normalize_insider(read(v.raw_insider(), schema.INSIDER), now),
        "stocktwits": lambda: normalize.normalize_stocktwits(read(v.raw_stocktwits(), schema.STOCKTWITS), now),
        "yahoo_rss": lambda: feeds.normalize_yahoo_rss(v.raw_rss("yahoo_rss"), now),
        "googlenews_rss": lambda: feeds.normalize_google_rss(v.raw_rss("googlenews_rss"), now),
        "gdelt": lambda: feeds.normalize_gdelt(feeds.gkg_rows(v.raw_gkg()), now),
    }
    return makers[source]()


for _s in PARTS:
    query(f"normalize_{_s}", PARTS[_s])(lambda v, s=_s: flat(parse(v, s)))


def all_items(v: Views) -> DataFrame:
    return setops.select_feeds({s: parse(v, s) for s in PARTS})


@query("union_feed", " union all ".join(f"({sql})" for sql in PARTS.values()))
def union_feed(v: Views):
    return flat(all_items(v))


ITEMS = ", items as (" + " union all ".join(f"({sql})" for sql in PARTS.values()) + ")"


@query("valid_items", ITEMS + """ select id, url from items where url like 'http%' and tickers<>''""")
def valid_items(v: Views):
    return filters.valid_items(all_items(v), need_http=True, need_tickers=True).select("id", "url")


@query("run_summary", ITEMS + """ select count(*) items, cast(sum(case when tickers='' then 0 else len(string_split(tickers,',')) end) as bigint) mentions from items""")
def run_summary(v: Views):
    return fx.run_summary(all_items(v))


@query("mention_leaders", ITEMS + """ select symbol, count(*) mentions from (select unnest(string_split(tickers,',')) symbol from items where tickers<>'')
  group by 1 order by 2 desc, 1 limit 15""")
def mention_leaders(v: Views):
    return fx.mention_leaders(all_items(v))


@query("known_tickers", f""", named as ({PARTS['alphavantage']})
  select id, case when sym in (select symbol from tickers) then sym else '' end tickers from (select id, string_split(tickers,',')[1] sym from named)""")
def known_tickers(v: Views):
    items = filters.known_tickers(parse(v, "alphavantage"), v.tickers)
    return items.select("id", F.array_join("tickers", ",").alias("tickers"))


@query("provider_scores", """ select event_id, sym ticker, case when event_id%4<>0 then (event_id%9+1)/1e1 else 0.125e0 end sentiment
  from ev where source='alphavantage'""")
def provider_scores(v: Views):
    items = parse(v, "alphavantage")
    mentions = items.select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("event_id"), F.get("tickers", F.lit(0)).alias("ticker"),
        F.lit(0.125).alias("sentiment"), "provider_scores")
    return normalize.prefer_provider_score(mentions).drop("provider_scores")


@query("theme_filter", f"""select strftime(ts,'%Y%m%d%H%M%S') as date, case when event_id%10=0 then 'ftp://example.com/x' else {URL} end url
  from ev where event_id%13<>0 and event_type in ('purchase','error','view')""")
def theme_filter(v: Views):
    return filters.filter_themes(feeds.gkg_rows(v.raw_gkg())).select("date", "url")


@query("cap_per_feed", f"""select source, ticker, event_id from (
  select source, sym ticker, event_id, row_number() over (partition by source, sym order by ts desc, event_id) n from ev) where n<={vocab.RSS_ITEMS_PER_FEED}""")
def cap_per_feed(v: Views):
    rows = v.events.select("source", F.col("sym").alias("ticker"), "event_id", "ts")
    capped = topk.cap_per_key(rows, ["source", "ticker"], vocab.RSS_ITEMS_PER_FEED, [F.desc("ts"), F.asc("event_id")])
    return capped.drop("ts")


NEW_URLS = """, stored as (select url from articles where source='stocktwits')
  select url, min(id) id from articles where source<>'stocktwits' and url not in (select url from stored) group by 1"""


@query("known_urls_anti", NEW_URLS)
def known_urls_anti(v: Views):
    """First item per URL that no stored social message already has."""
    stored = v.articles.filter("source = 'stocktwits'")
    batch = v.articles.filter("source <> 'stocktwits'")
    return dedup.drop_known_urls(batch, stored, ["id"]).select("url", "id")


@query("known_urls_filtered", NEW_URLS)
def known_urls_filtered(v: Views):
    """The same against a stored feed, of which only the dates that its URL filters name are read."""
    path = session.scratch_path(v.spark, "filtered")
    messages = schema.conform(v.articles.filter("source = 'stocktwits'"), schema.ARTICLES)
    store.write_table(messages, f"{path}/articles", 0)
    url_filter.write(messages, path, 0)
    batch = v.articles.filter("source <> 'stocktwits'")
    near = url_filter.narrowed(store.load_articles(v.spark, path), batch, path)
    return dedup.drop_known_urls(batch, near, ["id"]).select("url", "id")


@query("page_ids", """select page_id, concat('page-',substr(md5(url),1,12)) stable,
  nullif(trim(regexp_extract(html,'(?s)<title>(.*?)</title>',1)),'') title from pages""")
def page_ids(v: Views):
    return v.table("pages").select(
        "page_id", text.stable_id("page", "url").alias("stable"),
        text.blank_to_null(text.strip(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("title"))


ANSWER = """
  select event_id, case when event_id%6 in (3,4) then null else sym end ticker,
    case when event_id%6 in (3,4) then null else event_id%5<>0 end is_relevant,
    case when event_id%6 in (3,4) then null else greatest(-1e0,least(1e0,""" + r4(
        "(case when event_id%2=0 then -1e0 else 1e0 end)*((case when event_id%6=5 then 3e0 else 0e0 end)+(event_id*37%10000)/1e4)") + """)) end sentiment,
    case when event_id%6 in (3,4) then null else event_type end summary from ev"""


@query("response_parse", ANSWER)
def response_parse(v: Views):
    return models.parse_scores(v.responses()).select("event_id", "analysis.*")


@query("confirmed_mentions", f"select event_id, ticker, sentiment from ({ANSWER}) where is_relevant")
def confirmed_mentions(v: Views):
    parsed = models.parse_scores(v.responses()).select("event_id", "analysis.*")
    return filters.confirmed_mentions(parsed).select("event_id", "ticker", "sentiment")


@query("lead_sentiment", f"""select article_id, arg_min(sentiment, id) filter (where sentiment is not null or sentiment is null) sentiment
  from mentions group by 1""".replace("arg_min(sentiment, id) filter (where sentiment is not null or sentiment is null)", "list(sentiment order by id)[1]"))
def lead_sentiment(v: Views):
    grouped = v.mentions.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("id", "sentiment"))).alias("confirmed"))
    return topk.lead_sentiment(grouped).select("article_id", "sentiment")


@query("feed_store", """select 'article' kind, count(*) n from articles union all select 'mention', count(*) from mentions""")
def feed_store(v: Views):
    """Articles and mentions written to the partitioned store twice and read back."""
    confirmed = v.mentions.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(
        "ticker", "sentiment", "source_weight", F.lit(None).cast("string").alias("summary")))).alias("confirmed"))
    items = v.articles.join(confirmed.withColumnRenamed("article_id", "id"), "id").withColumn(
        "id", F.col("id").cast("string")).withColumn("url", F.concat("url", F.lit("#"), "id"))
    items = session.durable(items)
    path = session.scratch_path(v.spark, "store")
    for _ in range(2):
        store.write_feed(items, path, 0, v.tickers)
    a, m = store.load_articles(v.spark, path), store.load_mentions(v.spark, path)
    return a.agg(F.count("*").alias("n")).select(F.lit("article").alias("kind"), "n").unionByName(
        m.agg(F.count("*").alias("n")).select(F.lit("mention").alias("kind"), "n"))


def count_sql(words) -> str:
    """How often the words occur in `words_of`, a lower-case text."""
    return "(" + "+".join(f"(length(words_of)-length(replace(words_of,'{w}','')))//{len(w)}" for w in words) + ")"


# Bodies stand for their first arrival; the others of a kept body are its copies.
INGESTED = ITEMS + """,
 valid as (select *, case when source='googlenews_rss'
     then coalesce(nullif(trim(regexp_replace(title,'\\s+-\\s+[^-]+$','')),''),title) else content end body
   from items where url<>'' and content is not null),
 fresh as (select * exclude (n) from (select *, row_number() over (partition by url order by "timestamp", id, content, sentiment nulls first) n from valid) where n=1),
 first as (select * exclude (n), row_number() over (order by "timestamp", id) r from (
   select *, row_number() over (partition by body order by "timestamp", id) n from fresh) where n=1)""" + edges_sql("first", "r", "body") + WALK + f""",
 kept as (select * from first where r not in (select id from nodes) or list_contains((select kept from final), r)),
 named as (select *, source in {inlist(vocab.NAMED_TICKER_SOURCES)} own from kept),
 pairs as (select id, ticker, pos from (
     select id, unnest(string_split(tickers,',')) ticker, generate_subscripts(string_split(tickers,','),1) pos from named where own)
     where ticker in (select symbol from tickers)
   union all select distinct id, ticker, 0 from (select id, ltrim(unnest(regexp_extract_all(concat(coalesce(title,''),' ',content),
       '\\$[A-Z]{{2,5}}\\b|\\b[A-Z]{{2,5}}\\b')),'$') ticker from named
     where not own or (source in {inlist(vocab.SCAN_FALLBACK_SOURCES)} and tickers=''))
     where ticker in (select symbol from tickers) and ticker not in {inlist(vocab.ARTICLE_STOPWORDS)}),
 read as (select *, {count_sql(models.LexiconScorer.GOOD)} good, {count_sql(models.LexiconScorer.BAD)} bad from (
   select *, lower(concat(coalesce(title,''),e'\\n\\n',content)) words_of from kept)),
 rated as (select id, source, url, case when source in {inlist(vocab.PRESCORED_SOURCES)} or (source='alphavantage' and sentiment is not null)
     then sentiment when good+bad=0 then 0e0 else {r4('(good-bad)/cast(good+bad as double)')} end s
   from read where source in {inlist(vocab.PRESCORED_SOURCES)} or trim(words_of,e' \\n')<>'')
 select id, source, url, count(*) mentions, {r4('any_value(s)')} sentiment from rated join pairs using (id) group by 1,2,3"""


@query("ingest", INGESTED)
def ingest(v: Views):
    """The whole job over the union of all feeds, with the stand-in models."""
    path = session.scratch_path(v.spark, "ingest")
    stored = ing.ingest(all_items(v), path, v.tickers, models.LexiconScorer(), hashing_encoder, v.as_of)
    return stored.select("id", "source", "url", F.size("confirmed").cast("bigint").alias("mentions"), scores.round4("sentiment").alias("sentiment"))
