"""Ticker pages, timelines and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions import scores, vocab
from tidewatch.operators import facts as fx
from tidewatch.operators import models, timeline, topk, vector
from tidewatch.plans import search as sx
from tidewatch.plans import ticker
from tidewatch.sources import postings

from .boards import COUNTED, RECENT, since
from .catalog import inlist, lit, mean, query, r4, sym, units
from .views import Views, ntz, symbol

# Ticker pages

REQUESTS = f""", requests as (select distinct upper(s) symbol from (
  select lower({sym('user_id')}) s from events union all select concat({sym('user_id')},'z') from events where user_id%10=0))"""


def requests(v: Views):
    """Symbols people asked for: lower case, some unknown."""
    users = v.table("events").select("user_id").distinct()
    known = users.select(F.lower(symbol("user_id")).alias("symbol"))
    return known.unionByName(users.filter("user_id % 10 = 0").select(F.concat(symbol("user_id"), F.lit("z")).alias("symbol")))


@query("ticker_profile", REQUESTS + """select r.symbol, sector, company_name, t.symbol is not null found
  from requests r left join tickers t on t.symbol=r.symbol""")
def ticker_profile(v: Views):
    return fx.ticker_profile(requests(v), v.tickers)


def detail_sql(hours: int) -> str:
    return REQUESTS + f""",
 m as (select ticker, sum(case when {since(1)} then 1 else 0 end) m1, count(*) m, {mean('sentiment')} s
       from facts where {since(hours)} and {COUNTED} group by 1),
 g as (select ticker, {r4(mean('sentiment'))} gauge from facts where {since(0.25)} and {COUNTED} group by 1)
 select r.symbol, company_name, sector, t.symbol is not null found,
   case when t.symbol is not null then cast(coalesce(m1,0) as bigint) end mentions_1h,
   case when t.symbol is not null then coalesce(m,0) end mentions_24h, {r4('s')} sentiment,
   case when t.symbol is not null then {r4("coalesce(m1,0)*3e0+coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} end score,
   case when t.symbol is not null then coalesce(m,0)>0 and cast(coalesce(m1,0) as double) > cast(coalesce(m,0) as double)/{hours}e0*2e0 end spike,
   gauge gauge_sentiment_15m
 from requests r left join tickers t on t.symbol=r.symbol left join m on m.ticker=t.symbol left join g on g.ticker=t.symbol"""


@query("ticker_detail", detail_sql(24))
def ticker_detail(v: Views):
    return ticker.ticker_detail(requests(v), v.tickers, v.facts, "24h", v.as_of)


@query("ticker_detail_7d", detail_sql(168))
def ticker_detail_7d(v: Views):
    return ticker.ticker_detail(requests(v), v.tickers, v.facts, "7d", v.as_of)


def news_sql(window: str, exact: bool = False) -> str:
    hours, limit = vocab.WINDOW_HOURS[window], vocab.NEWS_LIMIT[window]
    sql = f""",
 page as (select * from (select ticker symbol, article_id id, source, title, url, ts, {r4('sentiment')} sentiment,
            row_number() over (partition by ticker order by ts desc, article_id, mention_id) rn
          from facts where {since(hours)} and {COUNTED} and ticker in (select symbol from tickers)) where rn<={limit}),
 keyed as (select *, coalesce(nullif(lower(trim(regexp_replace(title,'\\s+-\\s+[^-]+$',''))),''), cast(id as varchar)) k from page),
 news as (select symbol,id,source,title,url,ts as "timestamp",sentiment from (
            select *, row_number() over (partition by symbol,k order by ts desc,id) n from keyed) where n=1)"""
    if exact:
        sql += """,
 unique_news as (select * exclude (n) from (select *, row_number() over (
   partition by symbol, coalesce(lower(trim(title)),cast(id as varchar)) order by "timestamp" desc, id) n from news) where n=1)"""
    return sql


for _w in ("6h", "24h", "3d", "7d"):
    query(f"ticker_news_{_w}", news_sql(_w) + " select * from news")(
        lambda v, w=_w: ticker.ticker_news(v.tickers.select("symbol"), v.titled_facts, w, v.as_of)
    )


@query("dedupe_titles", """select symbol, count(*) kept, cast(sum(id) as bigint) ids from (
  select symbol, id, row_number() over (partition by symbol, k order by ts desc, id) n from (
    select ticker symbol, article_id id, ts, coalesce(nullif(lower(trim(regexp_replace(title,'\\s+-\\s+[^-]+$',''))),''), cast(article_id as varchar)) k
    from facts)) where n=1 group by 1""")
def dedupe_titles(v: Views):
    news = v.titled_facts.select(F.col("ticker").alias("symbol"), F.col("article_id").alias("id"), "title", "timestamp")
    return topk.dedupe_titles(news, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


@query("dedupe_exact_titles", """select symbol, count(*) kept, cast(sum(id) as bigint) ids from (
  select ticker symbol, article_id id, row_number() over (
    partition by ticker, lower(trim(coalesce(title, cast(article_id as varchar)))) order by ts desc, article_id) n from facts)
  where n=1 group by 1""")
def dedupe_exact_titles(v: Views):
    news = v.titled_facts.select(F.col("ticker").alias("symbol"), F.col("article_id").alias("id"), "title", "timestamp")
    return topk.dedupe_exact_titles(news, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


def timeline_sql(window: str) -> str:
    size = vocab.TIMELINE_BUCKET_SECONDS[window] * 1000
    return news_sql(window, exact=True) + f""",
 ms as (select *, epoch_us("timestamp")//1000 as e from unique_news),
 points as (select symbol, e-e%{size} ts, {mean('coalesce(sentiment,0e0)')} sentiment, count(*) mentions,
              arg_min(id, row("timestamp", id)) article_id from ms group by 1,2)"""


for _w in ("6h", "24h", "3d", "7d"):
    query(f"sentiment_timeline_{_w}", timeline_sql(_w) + f" select symbol, ts, {r4('sentiment')} sentiment, mentions, article_id from points")(
        lambda v, w=_w: ticker.ticker_timeline(v.tickers.select("symbol"), v.titled_facts, w, v.as_of).withColumn(
            "sentiment", scores.round4("sentiment"))
    )

MARKS = """, marks as (select distinct sym symbol, epoch_us(ts)//1000 ts from ev where source='stocktwits')"""


def marks(v: Views):
    """Moments of social messages, to be placed on the news timeline."""
    return v.of_source("stocktwits").select(F.col("sym").alias("symbol"), timeline.epoch_ms("ts").alias("ts"))


@query("nearest_article", MARKS + """,
 nodes as (select sym symbol, epoch_us(ts)//1000 ts, min(event_id) id from ev where source<>'stocktwits' group by 1,2),
 p as (select m.symbol, m.ts, n.ts pts, n.id pid from marks m asof left join nodes n on m.symbol=n.symbol and m.ts>=n.ts),
 q as (select m.symbol, m.ts, n.ts nts, n.id nid from marks m asof left join nodes n on m.symbol=n.symbol and m.ts<=n.ts)
 select p.symbol, p.ts, case when pid is null then nid when nid is null then pid when p.ts-pts<=nts-p.ts then pid else nid end article_id
 from p join q on p.symbol=q.symbol and p.ts=q.ts""")
def nearest_article(v: Views):
    news = v.events.filter("source <> 'stocktwits'").select(
        F.col("sym").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    return timeline.nearest_article(marks(v), news)


AROUND = """,
 p as (select m.symbol, m.ts, n.ts pts, n.sentiment ps from marks m asof left join points n on m.symbol=n.symbol and m.ts>=n.ts),
 q as (select m.symbol, m.ts, n.ts nts, n.sentiment ns from marks m asof left join points n on m.symbol=n.symbol and m.ts<=n.ts)"""


@query("nearest_bucket", timeline_sql("7d") + MARKS + AROUND + """
 select p.symbol, p.ts, case when pts is null then nts when nts is null then pts when p.ts-pts<=nts-p.ts then pts else nts end bucket_ts
 from p join q on p.symbol=q.symbol and p.ts=q.ts""")
def nearest_bucket(v: Views):
    points = ticker.ticker_timeline(v.tickers.select("symbol"), v.titled_facts, "7d", v.as_of)
    return timeline.nearest_bucket(marks(v), points)


@query("timeline_interpolate", timeline_sql("7d") + MARKS + AROUND + f"""
 select p.symbol, p.ts, {r4("case when pts is null then ns when nts is null then ps when nts=pts then ps else ps+(cast(p.ts-pts as double)/cast(nts-pts as double))*(ns-ps) end")} sentiment
 from p join q on p.symbol=q.symbol and p.ts=q.ts""")
def timeline_interpolate(v: Views):
    points = ticker.ticker_timeline(v.tickers.select("symbol"), v.titled_facts, "7d", v.as_of)
    return timeline.interpolate_timeline(marks(v), points).withColumn("sentiment", scores.round4("sentiment"))


# Search ingredients

@query("latest_per_url", f"""select * from (select ticker, id, url, ts as "timestamp", {r4('sentiment')} sentiment,
   row_number() over (partition by ticker order by ts desc, id desc) rn from (
   select ticker, article_id id, url, ts, sentiment,
     row_number() over (partition by ticker, url order by article_id desc, ts desc, sentiment desc nulls last) n from facts) where n=1) where rn<=10""".replace("select * from (", "select * exclude (rn) from (", 1))
def latest_per_url(v: Views):
    news = v.facts.select("ticker", F.col("article_id").alias("id"), "url", "timestamp", "sentiment")
    return topk.latest_per_url(news, 10, ["ticker"]).withColumn("sentiment", scores.round4("sentiment"))


@query("url_dedupe", """select url, max(id) id from articles group by 1""")
def url_dedupe(v: Views):
    return topk.latest_per_url(v.articles, None).select("url", "id")


@query("keyword_search", """select id, title, url, "timestamp" from (
  select *, row_number() over (partition by url order by id desc) n from articles
  where title ilike '%widget%' or content ilike '%widget%' or title ilike '%purchase%' or content ilike '%purchase%') where n=1
  order by "timestamp" desc, id desc limit 10""")
def keyword_search(v: Views):
    return sx.keyword_search(v.articles, "Widget purchase of").select("id", "title", "url", "timestamp")


LOOSE = """, words as (select distinct query_id, w from (select query_id, unnest(string_split_regex(lower(trim(query)),'\\s+')) w from query_log) where length(w)>2)"""


def keyword_hits(articles: str = "articles") -> str:
    return LOOSE + f""",
 hits as (select distinct w.query_id, a.id, a.url, a."timestamp" from (select distinct w from words) d
   join {articles} a on contains(lower(a.title), d.w) or contains(lower(a.content), d.w) join words w on w.w=d.w),
 one as (select *, row_number() over (partition by query_id, url order by id desc) n from hits)
 select query_id, id, url, "timestamp" from (select *, row_number() over (partition by query_id order by "timestamp" desc, id desc) r from one where n=1) where r<=10"""


@query("keyword_search_batch", keyword_hits())
def keyword_search_batch(v: Views):
    log = v.query_log.select("query_id", F.col("query").alias("raw_query"))
    return sx.keyword_search_batch(log, v.articles).select("query_id", "id", "url", "timestamp")


@query("keyword_postings", keyword_hits("""(select id, title, content, "timestamp",
   case when id%3<>0 then concat(url,'#',id) else url end url from articles)"""))
def keyword_postings(v: Views):
    """Keywords looked up in kept postings; every third article shares its URL with others."""
    path = session.scratch_path(v.spark, "postings")
    own = F.when(F.col("id") % 3 != 0, F.concat_ws("#", "url", "id")).otherwise(F.col("url"))
    articles = v.articles.withColumn("url", own)
    postings.write(articles, path, 0)
    log = v.query_log.select("query_id", F.col("query").alias("raw_query"))
    return postings.search(v.spark, log, path, articles).select("query_id", "id", "url", "timestamp")


@query("partial_ticker_match", """, terms as (select distinct upper(substr(p_name,1,3)) t from ev where p_name is not null
    union select distinct substr(sym,2,2) from ev)
 select t term, symbol, company_name from (select *, row_number() over (partition by t order by symbol) n from terms
   join tickers on contains(lower(symbol),lower(t)) or contains(lower(coalesce(company_name,'')),lower(t))) where n<=5""")
def partial_ticker_match(v: Views):
    a = v.events.select(F.upper(F.substring("p_name", 1, 3)).alias("term")).filter("term is not null")
    b = v.events.select(F.substring("sym", 2, 2).alias("term"))
    terms = a.unionByName(b).distinct().select(F.col("term").alias("query_id"), F.lit(0).alias("pos"), "term")
    return sx.partial_ticker_match(v.tickers, terms).select(F.col("query_id").alias("term"), "symbol", "company_name")


@query("related_tickers", """select distinct ticker symbol from mentions where article_id in (
  select id from articles where title ilike '%rod%')""")
def related_tickers(v: Views):
    ids = v.articles.filter(F.col("title").ilike("%rod%")).select(F.col("id").alias("article_id"))
    return fx.related_tickers(ids, v.mentions)


def _keyword_rows() -> str:
    rows = ",".join(f"({i},'{w}','{s}')" for i, (w, s) in enumerate(vocab.SECTOR_KEYWORDS.items()))
    return f"(values {rows}) as k(i,w,s)"


INTENT = f""",
 q as (select query_id, trim(query) raw, lower(trim(query)) l from query_log),
 sec as (select query_id, list(s order by i) sectors from (
   select query_id, s, min(i) i from q join {_keyword_rows()} on contains(l, w) group by 1,2) group by 1),
 found as (select query_id, unnest(regexp_extract_all(raw,'\\$?([A-Z]{{1,5}})\\b',1)) t,
   generate_subscripts(regexp_extract_all(raw,'\\$?([A-Z]{{1,5}})\\b',1),1) i from q),
 tic as (select query_id, list(t order by i) tickers from (select query_id, t, min(i) i from found
   where t not in {inlist(vocab.QUERY_STOPWORDS)} group by 1,2) group by 1),
 parsed as (select q.query_id, raw, coalesce(sectors,[]) sectors, coalesce(tickers,[]) tickers,
   list_filter(string_split_regex(l,'\\W+'), lambda w: length(w)>1 and w not in {inlist([w for w in vocab.SECTOR_KEYWORDS if ' ' not in w])}) keywords,
   l from q left join sec on sec.query_id=q.query_id left join tic on tic.query_id=q.query_id),
 intents as (select query_id, raw, sectors, tickers, keywords,
   case when len(sectors)>0 then 'sector_search' when len(tickers)>0 then 'ticker_lookup'
        when {' or '.join(f"contains(l,'{w}')" for w in vocab.NEWS_WORDS)} then 'news_search' else 'general_search' end intent from parsed)"""


@query("query_intent", INTENT + """select query_id, intent, array_to_string(sectors,'|') sectors,
  array_to_string(tickers,'|') tickers, array_to_string(keywords,'|') keywords from intents""")
def query_intent(v: Views):
    parsed = sx.classify_queries(v.query_log)
    return parsed.select("query_id", "intent", *[F.array_join(c, "|").alias(c) for c in ("sectors", "tickers", "keywords")])


# Search answers: article and query vectors from the built-in hashing encoder

DIM = 64


def _vectors(name: str, source: str, id_col: str, text: str) -> str:
    """Unit vectors of hashed word counts as FLOAT lists."""
    return f""",
 {name}_slots as (select {id_col} vid, cast(('0x'||substr(md5(w),1,8)) as bigint)%{DIM} d from (
   select {id_col}, unnest(regexp_extract_all(lower({text}),'[\\p{{L}}\\p{{N}}_]+')) w from {source})),
 {name}_counts as (select vid, d, count(*) c from {name}_slots group by 1,2),
 {name} as (select vid, d, cast(c/sqrt(sum(c*c) over (partition by vid)) as float) x from {name}_counts)"""


SEARCH = INTENT + RECENT + f""",
 sc as (select symbol, company_name, sector, {r4("coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} score, coalesce(m,0) mentions_24h,
   {r4("coalesce(s,0e0)")} sentiment from tickers left join recent on ticker=symbol),
 asked as (select query_id, unnest(sectors) sector, generate_subscripts(sectors,1)-1 pos from intents where intent='sector_search'),
 sbest as (select *, row_number() over (partition by sector order by score desc, symbol) rn from sc where sector is not null),
 by_sector as (select a.query_id, a.pos, s.* exclude (rn) from asked a join sbest s on s.sector=a.sector where rn<=10),
 named as (select query_id, unnest(tickers) symbol, generate_subscripts(tickers,1)-1 pos from intents where intent='ticker_lookup'),
 exact_all as (select n.query_id, 0 pos, sc.*, row_number() over (partition by n.query_id order by score desc, sc.symbol) rn from named n join sc on sc.symbol=n.symbol),
 exact as (select * exclude (rn) from exact_all where rn<=10),
 loose as (select * from intents where intent in ('news_search','general_search')){_vectors('av', 'articles', 'id', 'title')}{_vectors('qv', 'loose', 'query_id', 'raw')},
 dots as (select q.vid query_id, a.vid id, sum(cast(q.x as double)*cast(a.x as double)) dot from qv q join av a on a.d=q.d group by 1,2),
 norms as (select vid, sqrt(sum(cast(x as double)*cast(x as double))) n from av group by 1),
 qnorms as (select vid, sqrt(sum(cast(x as double)*cast(x as double))) n from qv group by 1),
 dist as (select l.query_id, a.id, a.url, floor((1e0-coalesce(dot/(n.n*qn.n),0e0))*1e6+0.5e0)/1e6 d
   from loose l cross join articles a left join dots on dots.query_id=l.query_id and dots.id=a.id
   left join norms n on n.vid=a.id left join qnorms qn on qn.vid=l.query_id),
 near_url as (select *, row_number() over (partition by query_id,url order by d,id) u from dist),
 near as (select query_id, id, rn from (select *, row_number() over (partition by query_id order by d,id) rn from near_url where u=1) where rn<=10),
 related as (select distinct query_id, ticker symbol from near n join mentions m on m.article_id=n.id),
 rel_best as (select r.query_id, 0 pos, sc.*, row_number() over (partition by r.query_id order by score desc, sc.symbol) rn from related r join sc on sc.symbol=r.symbol),
 terms as (select query_id, pos, symbol term from named where query_id not in (select query_id from exact)),
 pm as (select *, row_number() over (partition by term order by symbol) n from (select distinct lower(term) term from terms) t
   join tickers k on contains(lower(k.symbol),t.term) or contains(lower(coalesce(k.company_name,'')),t.term)),
 partial as (select t.query_id, min(t.pos) pos, pm.symbol, any_value(company_name) company_name, any_value(sector) sector
   from terms t join pm on pm.term=lower(t.term) where pm.n<=5 group by 1,3),
 flat as (select query_id, pos, symbol, company_name, sector, score, mentions_24h, sentiment from by_sector
   union all select query_id, pos, symbol, company_name, sector, score, mentions_24h, sentiment from exact
   union all select query_id, pos, symbol, company_name, sector, score, mentions_24h, sentiment from rel_best where rn<=10
   union all select query_id, pos, symbol, company_name, sector, 0e0, 0, null from partial),
 best as (select * from (select *, cast(row_number() over (partition by query_id order by pos, score desc, symbol) as integer) as rank from flat) where rank<=10),
 chosen as (select query_id, symbol from flat where query_id in (select query_id from intents where intent in ('sector_search','ticker_lookup')))
"""


def answered(v: Views) -> sx.SearchResult:
    articles = v.articles.withColumn("embedding", models.hashed_vector("title", DIM))
    queries = v.query_log.withColumn("embedding", models.hashed_vector("query", DIM))
    return sx.search(queries, v.tickers, articles, v.mentions, v.as_of)


@query("search_tickers", SEARCH + "select query_id, rank, symbol, company_name, sector, score, mentions_24h, sentiment from best")
def search_tickers(v: Views):
    return answered(v).tickers


NEWS = f""",
 cn as (select c.query_id, f.article_id id, f.source, f.title, f.url, f.ts, f.sentiment,
   row_number() over (partition by c.query_id, f.url order by f.article_id desc, f.ts desc, f.sentiment desc nulls last) n
   from chosen c join facts f on f.ticker=c.symbol),
 tn as (select *, cast(row_number() over (partition by query_id order by ts desc, id desc) as integer) as rank from cn where n=1),
 search_rows as (select query_id, rank, id, source, title, url, ts as "timestamp", {r4('sentiment')} sentiment from tn where rank<=10
 union all
 select n.query_id, cast(n.rn as integer), n.id, a.source, a.title, a.url, a."timestamp", s.s from near n join articles a on a.id=n.id
 left join (select article_id, {r4(mean('sentiment'))} s from mentions group by 1) s on s.article_id=n.id)"""


@query("search_news", SEARCH + NEWS + "select * from search_rows")
def search_news(v: Views):
    return answered(v).news


TRENDS = f""",
 wanted as (select query_id, symbol from chosen union all select query_id, symbol from related),
 tr as (select w.query_id, w.symbol, cast(coalesce(m1,0) as bigint) mentions_1h, coalesce(m,0) mentions_24h, {r4("coalesce(s,0e0)")} sentiment,
   {r4("coalesce(m1,0)*3e0+coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} score,
   coalesce(m,0)>0 and cast(coalesce(m1,0) as double) > cast(coalesce(m,0) as double)/24e0*2e0 spike
   from wanted w left join recent on ticker=w.symbol),
 trend_rows as (select query_id, rank, symbol, mentions_1h, mentions_24h, sentiment, score, spike from (
   select *, cast(row_number() over (partition by query_id order by score desc, symbol) as integer) as rank from tr) where rank<=10)"""


@query("search_trends", SEARCH + TRENDS + "select * from trend_rows")
def search_trends(v: Views):
    return answered(v).trends


@query("search_batch", SEARCH + NEWS + TRENDS + """
 select i.query_id, intent, coalesce(t.l,'') tickers, coalesce(n.l,'') news, coalesce(r.l,'') trends from intents i
 left join (select query_id, string_agg(symbol,'|' order by rank) l from best group by 1) t on t.query_id=i.query_id
 left join (select query_id, string_agg(cast(id as varchar),'|' order by rank) l from search_rows group by 1) n on n.query_id=i.query_id
 left join (select query_id, string_agg(symbol,'|' order by rank) l from trend_rows group by 1) r on r.query_id=i.query_id""")
def search_batch(v: Views):
    """The nested answer of every query, its lists shown as text."""
    pages = answered(v).nested()
    return pages.select(
        "query_id", "intent", F.array_join("tickers.symbol", "|").alias("tickers"),
        F.array_join(F.transform("news", lambda n: n["id"].cast("string")), "|").alias("news"),
        F.array_join("trend_data.symbol", "|").alias("trends"))


# Vectors: the mean vector of each label looks for its nearest rows

CENTRES = """,
 dims as (select vec_id, label, unnest(embedding) x, generate_subscripts(embedding,1) d from embeddings),
 centres as (select label query_id, d, cast(sum(cast(floor(cast(x as double)*1e6+0.5e0) as bigint)) as double) x from dims group by 1,2)"""


def centres(v: Views):
    spread = v.table("embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    micro = F.floor(F.col("x").cast("double") * 1e6 + 0.5).cast("bigint")
    sums = spread.groupBy("label", "d").agg(F.sum(micro).alias("x"))
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return rows.select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"].cast("double")).alias("embedding"))


def corpus(v: Views):
    return v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")


NEAREST = CENTRES + """,
 cn as (select query_id, sqrt(sum(x*x)) n from centres group by 1),
 vn as (select vec_id, sqrt(sum(cast(x as double)*cast(x as double))) n from dims group by 1),
 dd as (select c.query_id, v.vec_id id, sum(c.x*cast(v.x as double)) dot from centres c join dims v on v.d=c.d group by 1,2),
 dist as (select dd.query_id, id, floor((1e0-dot/(cn.n*vn.n))*1e6+0.5e0)/1e6 distance from dd join cn on cn.query_id=dd.query_id join vn on vn.vec_id=id)
 select query_id, id, distance, rank from (select *, cast(row_number() over (partition by query_id order by distance, id) as integer) as rank from dist) where rank<=10"""


@query("knn_articles", NEAREST)
def knn_articles(v: Views):
    return vector.knn(centres(v), corpus(v), 10)


@query("knn_bucketed", NEAREST)
def knn_bucketed(v: Views):
    """The inverted-list form with all lists probed, which must be exact; the recall of fewer is measured in the tests."""
    return vector.knn_bucketed(centres(v), corpus(v), 10, lists=20, probes=20)


@query("knn_index", NEAREST)
def knn_index(v: Views):
    """A kept index, written in two batches and read back, with all lists probed."""
    path, rows = session.scratch_path(v.spark, "index"), corpus(v)
    late = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    vector.write_index(rows.filter(~late), path, 20)
    vector.append_index(rows.filter(late), path, 1)
    return vector.knn_index(centres(v), path, 10, probes=20)
