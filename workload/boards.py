"""Boards, their ingredients and the maintenance of mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions import scores, vocab
from tidewatch.operators import facts as fx
from tidewatch.operators import filters, maintenance, setops, topk
from tidewatch.plans import trending
from tidewatch.sources import store

from .catalog import at, inlist, mean, query, r4, units, weight_case
from .views import SECTOR_QUERIES, Views, ntz

COUNTED = "source<>'stocktwits'"


def since(hours: float) -> str:
    return f"ts >= (select t from latest) - to_seconds({int(hours * 3600)})"


def ranking(hours: int, sector: str | None = None) -> str:
    """The board computation as separate aggregates, joined."""
    only = f" and ticker in (select symbol from tickers where sector='{sector}')" if sector else ""
    z = "case when g is null or g=0 then 0e0 else (coalesce(m1,0)-mu)/g end"
    return f""",
 hourly as (select ticker, date_trunc('hour',ts) h, count(*) c from facts
            where {since(168)} and {COUNTED}{only} group by 1,2),
 stats as (select ticker, cast(sum(c) as double)/cast(count(*) as double) mu,
                  case when count(*)>1 then sqrt(cast(count(*)*sum(c*c)-sum(c)*sum(c) as double)/cast(count(*)*(count(*)-1) as double)) end g
           from hourly group by 1),
 last_hour as (select ticker, count(*) m1 from facts where {since(1)} and {COUNTED}{only} group by 1),
 in_window as (select ticker, count(*) m from facts where {since(hours)} and {COUNTED}{only} group by 1),
 mood as (select ticker, cast(sum({units('sentiment')}*cast(floor(source_weight*1e2+0.5e0) as bigint)) as double)
                  /cast(sum(cast(floor(source_weight*1e2+0.5e0) as bigint)) as double)/1e6 s
          from facts where {since(hours)} and sentiment is not null{only} group by 1),
 joined as (select symbol, coalesce(sector,'Unknown') sector, coalesce(company_name,'') company_name,
                   coalesce(m1,0) m1, m, coalesce(s,0e0) s, {z} z
            from tickers t join in_window w on w.ticker=t.symbol left join last_hour l on l.ticker=t.symbol
            left join mood on mood.ticker=t.symbol left join stats st on st.ticker=t.symbol),
 ranked as (select symbol, sector, company_name,
                   {r4("(z*2e0+m*3e-1+s*2e0)*case when z>=2e0 then 1.3e0 else 1e0 end")} score,
                   m1 mentions_1h, m mentions_24h, {r4('s')} sentiment, 0e0 price_change_pct, {r4('z')} z_score, z>=2e0 spike
            from joined),
 board_rows as (select 'global' board, * from ranked union all select sector, * from ranked),
 boards as (select * from (select *, cast(row_number() over (partition by board order by score desc, symbol) as integer) as rank from board_rows) where rank<=10)
"""


def ranked(v: Views, hours: int = 24, sector: str | None = None):
    return trending.rank_tickers(v.facts, v.tickers, v.as_of, hours, sector)


@query("trending_global", ranking(24) + "select * from ranked order by score desc, symbol limit 10")
def trending_global(v: Views):
    return topk.top_global(ranked(v))


@query("trending_sector", ranking(24) + """select * exclude (rn) from (
  select *, row_number() over (partition by sector order by score desc, symbol) rn from ranked) where rn<=10""")
def trending_sector(v: Views):
    return topk.top_per_sector(ranked(v))


@query("trending_ranking", ranking(24) + "select * from ranked")
def trending_ranking(v: Views):
    return ranked(v)


for _window, _hours in vocab.WINDOW_HOURS.items():
    query(f"trending_window_{_window}", ranking(_hours) + "select * from ranked order by score desc, symbol limit 10")(
        lambda v, w=_window: trending.trending_window(v.facts, v.tickers, w, v.as_of)
    )


@query("trending_sector_window", ranking(72, "Technology") + "select * from ranked order by score desc, symbol limit 10")
def trending_sector_window(v: Views):
    return trending.trending_window(v.facts, v.tickers, "3d", v.as_of, "tech")


@query("trending_boards", ranking(24) + "select * from boards")
def trending_boards(v: Views):
    return trending.trending(v.facts, v.tickers, v.as_of)


@query("leaderboard_sink", ranking(24) + "select * from boards")
def leaderboard_sink(v: Views):
    """Boards written to the board store and read back."""
    path = session.scratch_path(v.spark, "boards")
    for _ in range(2):
        store.write_leaderboard(trending.trending(v.facts, v.tickers, v.as_of), path)
    return store.load_boards(v.spark, path)


@query("boards", ranking(24) + "select distinct board from boards")
def board_names(v: Views):
    return store.list_boards(trending.trending(v.facts, v.tickers, v.as_of))


@query("board_summary", ranking(24) + "select count(*) tickers, count(distinct sector) sectors from ranked")
def board_summary(v: Views):
    return fx.board_summary(ranked(v))


@query("relative_score", ranking(24) + f"""select board, symbol, rank, score,
  {r4("least(1e2, score/greatest(max(score) over (partition by board),1e0)*1e2)")} relative from boards""")
def relative_score(v: Views):
    out = topk.relative_score(trending.trending(v.facts, v.tickers, v.as_of), ["board"])
    return out.select("board", "symbol", "rank", "score", scores.round4("relative").alias("relative"))


@query("board_rank", ranking(72) + """select sector, symbol, score,
  cast(row_number() over (partition by sector order by score desc, symbol) as integer) as rank from (
   select *, row_number() over (partition by sector order by score desc, symbol) rn from ranked) where rn<=10""")
def board_rank(v: Views):
    return topk.with_rank(topk.top_per_sector(ranked(v, 72)), ["sector"]).select("sector", "symbol", "score", "rank")


@query("hourly_mentions", f"""select ticker, date_trunc('hour',ts) hour_bucket, count(*) mentions from facts
  where {since(168)} and {COUNTED} group by 1,2""")
def hourly_mentions(v: Views):
    return fx.hourly_mentions(v.facts, v.as_of).select("ticker", ntz("hour_bucket"), "mentions")


@query("baseline_stats", ranking(24) + f"select ticker, {r4('mu')} mu, {r4('g')} sigma from stats")
def baseline_stats(v: Views):
    stats = fx.baseline_stats(fx.hourly_mentions(v.facts, v.as_of))
    return stats.select("ticker", scores.round4("mu").alias("mu"), scores.round4("sigma").alias("sigma"))


@query("mentions_1h", f"select ticker, count(*) mentions_1h from facts where {since(1)} and {COUNTED} group by 1")
def mentions_1h(v: Views):
    return fx.mentions_last(v.facts, v.as_of, 1, "mentions_1h")


@query("mentions_24h", f"select ticker, count(*) mentions_24h from facts where {since(24)} and {COUNTED} group by 1")
def mentions_24h(v: Views):
    return fx.mentions_last(v.facts, v.as_of, 24, "mentions_24h")


@query("weighted_sentiment", ranking(24) + f"select ticker, {r4('s')} sentiment from mood")
def weighted_sentiment(v: Views):
    mood = fx.weighted_sentiment(v.facts, v.as_of)
    return mood.select("ticker", scores.round4("weighted_sentiment").alias("sentiment"))


@query("window_mentions", f"""select ticker, count(*) mentions from facts where {since(72)} and {COUNTED}
  and ticker in (select symbol from tickers where sector='Energy') group by 1""")
def window_mentions(v: Views):
    return fx.window_mentions(v.facts, v.tickers, v.as_of, 72, "oil")


@query("window_sentiment", ranking(6) + f"select ticker, {r4('s')} sentiment from mood where ticker in (select ticker from in_window)")
def window_sentiment(v: Views):
    mentioned = fx.window_mentions(v.facts, v.tickers, v.as_of, 6)
    mood = fx.window_sentiment(v.facts, mentioned, v.as_of, 6)
    return mood.select("ticker", scores.round4("weighted_sentiment").alias("sentiment"))


RECENT = f""", recent as (select ticker, count(*) m, sum(case when {since(1)} then 1 else 0 end) m1, {mean('sentiment')} s
  from facts where {since(24)} group by 1)"""


@query("ticker_scores", RECENT + f"""select symbol, company_name, sector,
  {r4("coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} score, coalesce(m,0) mentions_24h, {r4("coalesce(s,0e0)")} sentiment
  from tickers left join recent on ticker=symbol""")
def ticker_scores(v: Views):
    return fx.ticker_scores(v.tickers, v.facts, v.as_of)


@query("trend_data", RECENT + f"""select symbol, cast(coalesce(m1,0) as bigint) mentions_1h, coalesce(m,0) mentions_24h,
  {r4("coalesce(s,0e0)")} sentiment, {r4("coalesce(m1,0)*3e0+coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} score,
  coalesce(m,0)>0 and cast(coalesce(m1,0) as double) > (cast(coalesce(m,0) as double)/24e0)*2e0 spike
  from tickers left join recent on ticker=symbol""")
def trend_data(v: Views):
    return fx.trend_data(v.tickers.select("symbol"), v.facts, v.as_of)


@query("gauge_15m", f"""select ticker, {r4(mean('sentiment'))} gauge_sentiment_15m from facts
  where {since(0.25)} and {COUNTED} group by 1""")
def gauge_15m(v: Views):
    return fx.gauge_15m(v.facts, v.as_of)


@query("article_sentiment", f"select article_id, {r4(mean('sentiment'))} sentiment from mentions group by 1")
def article_sentiment(v: Views):
    return fx.article_sentiment(v.mentions).withColumn("sentiment", scores.round4("sentiment"))


@query("sentiment_labels", """select mention_id,
  case when sentiment>0.05e0 then 'positive' when sentiment<-0.05e0 then 'negative' else 'neutral' end sign,
  case when sentiment>=0.5e0 then 'Bullish' when sentiment<=-0.5e0 then 'Bearish' when sentiment>0.1e0 then 'Slightly Bullish'
       when sentiment<-0.1e0 then 'Slightly Bearish' else 'Neutral' end band from facts""")
def sentiment_labels(v: Views):
    return v.facts.select("mention_id", scores.sentiment_class("sentiment").alias("sign"),
                          scores.sentiment_band("sentiment").alias("band"))


@query("source_weights", f"select article_id, source, {weight_case('source')} weight from facts")
def source_weights(v: Views):
    return v.facts.select("article_id", "source", scores.source_weight("source").alias("weight"))


RESET = """, pending as (select id, ticker, article_id, sentiment,
  case when article_id%5<>0 then 1e0 else source_weight end source_weight from mentions)"""


def reset_weights(v: Views):
    """Mentions as an old writer left them: most with the default weight."""
    weight = F.when(F.col("article_id") % 5 != 0, F.lit(1.0)).otherwise(F.col("source_weight"))
    return v.mentions.withColumn("source_weight", weight)


@query("weight_audit", RESET + f"""select source, count(*) mention_count, {weight_case('source')} new_weight
  from pending p join articles a on a.id=p.article_id where source_weight=1e0 group by source""")
def weight_audit(v: Views):
    return maintenance.weight_audit(reset_weights(v), v.headers)


@query("weight_backfill", RESET + f"""select p.id, ticker, article_id, sentiment,
  case when source_weight=1e0 then {weight_case('a.source')} else source_weight end source_weight
  from pending p join articles a on a.id=p.article_id""")
def weight_backfill(v: Views):
    return maintenance.backfill_weights(reset_weights(v), v.headers).drop("created_at", "dt")


@query("retention", """, kept as (select id from articles where "timestamp" >= (select t from latest) - to_days(7))
  select 'articles' as table_name, id from kept union all
  select 'mentions', id from mentions where article_id in (select id from kept)""")
def retention(v: Views):
    articles, mentions = maintenance.retain(v.headers, v.mentions, v.as_of)
    return articles.select(F.lit("articles").alias("table_name"), "id").unionByName(
        mentions.select(F.lit("mentions").alias("table_name"), "id"))


@query("upsert_tickers", """, fresh as (select upper(substr(p_name,1,3)) symbol, min(p_brand) b from part group by 1)
  select symbol, sector, company_name from tickers
  union all select symbol, 'New', b from fresh where symbol not in (select symbol from tickers)""")
def upsert_tickers(v: Views):
    new = v.table("part").select(
        F.upper(F.substring("p_name", 1, 3)).alias("symbol"), F.lit("New").alias("sector"), F.col("p_brand").alias("company_name"))
    return maintenance.upsert_tickers(v.tickers, new)


@query("ticker_listing", "select symbol, sector, company_name from tickers")
def ticker_listing(v: Views):
    return v.tickers.orderBy("symbol")


@query("sector_filter", "select symbol, sector from tickers where sector='Healthcare'")
def sector_filter(v: Views):
    return filters.filter_sector(v.tickers, "pharma").select("symbol", "sector")


@query("resolve_sector", f"""select event_id, coalesce(
  (case lower(w) when 'ai' then 'Technology' when 'oil' then 'Energy' when 'bank' then 'Financials'
   when 'retail' then 'Consumer Discretionary' when 'pharma' then 'Healthcare' when 'utilities' then 'Utilities'
   when 'mining' then 'Materials' when 'media' then 'Communication Services' when 'reit' then 'Real Estate' end), w) sector
  from (select event_id, {at(SECTOR_QUERIES, 'user_id%10')} w from events)""")
def resolve_sector(v: Views):
    from .views import pick

    word = pick(SECTOR_QUERIES, F.col("user_id") % 10)
    return v.table("events").select("event_id", scores.resolve_sector(word).alias("sector"))


@query("priority_union", ranking(24) + """, first as (select symbol, cast(rank as bigint) as position from boards where board='global')
  select symbol, 0 as tier, position from first
  union all select symbol, 1, 0 from tickers where symbol not in (select symbol from first)""")
def priority_union(v: Views):
    first = trending.boards(ranked(v)).filter("board = 'global'").select("symbol", F.col("rank").alias("position"))
    return setops.priority_union(first, v.tickers)


@query("concat_results", RECENT + f""", sc as (select symbol, sector,
  {r4("coalesce(m,0)*1.5e0+coalesce(s,0e0)*2e0")} score from tickers left join recent on ticker=symbol),
  parts as (select 0 p, * from sc where sector='Technology' union all select 1, * from sc where sector='Energy')
  select symbol, sector, score from parts order by p, score desc, symbol limit 10""")
def concat_results(v: Views):
    scored = fx.ticker_scores(v.tickers, v.facts, v.as_of).select("symbol", "sector", "score")
    return setops.concat_results(*[filters.filter_sector(scored, s) for s in ("tech", "oil")])


@query("symbol_filter", f"""select ticker, count(*) n from facts where ticker in (
  select symbol from tickers where sector in {inlist(('Energy', 'Materials'))}) group by 1""")
def symbol_filter(v: Views):
    wanted = v.tickers.filter(F.col("sector").isin("Energy", "Materials")).select("symbol")
    return filters.filter_symbols(v.facts, wanted).groupBy("ticker").agg(F.count("*").alias("n"))
