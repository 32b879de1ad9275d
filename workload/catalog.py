"""Registry of queries and the SQL derivations shared by their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.functions import vocab

from .views import SECTOR_QUERIES, SECTORS, SOURCES, WEIGHTS_E2, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views under a name, with its SQL if there is one."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{DERIVED}\n{sql}"
        return fn

    return add


def r4(e: str) -> str:
    return f"(floor(({e})*1e4+0.5e0)/1e4)"


def units(e: str) -> str:
    return f"cast(floor(({e})*1e6+0.5e0) as bigint)"


def mean(e: str) -> str:
    """Exact mean of a sentiment expression."""
    return f"(cast(sum({units(e)}) as double)/cast(nullif(count({e}),0) as double)/1e6)"


def lit(values) -> str:
    return "[" + ",".join("'" + v + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ",".join("'" + v + "'" for v in values) + ")"


def at(values, index: str) -> str:
    return f"list_extract({lit(values)}, cast(({index}) as integer)+1)"


def sym(u: str) -> str:
    s = f"cast({u} as varchar)"
    return f"translate(case when length({s})<4 then lpad({s},4,'0') else {s} end,'0123456789','ABCDEFGHIJ')"


def weight_case(column: str) -> str:
    whens = " ".join(f"when {column}='{s}' then {w}e0" for s, w in vocab.SOURCE_WEIGHTS.items())
    return f"(case {whens} else 1e0 end)"


DERIVED = f"""
with recursive latest as (select max(ts) t, max(user_id) u from events),
ev as (
  select e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props, p.p_name,
         {sym('e.user_id')} sym, {at(SOURCES, 'e.event_id%12')} source
  from events e left join part p on p.p_partkey=e.user_id),
tickers as (
  select {sym('user_id')} symbol,
         case when user_id%23<>0 then {at(SECTORS, 'user_id%11')} end sector, p_name company_name
  from (select distinct user_id from events) u left join part p on p.p_partkey=u.user_id),
articles as (
  select event_id id, source, concat_ws(' ',sym,p_name,event_type,'-',source) title,
         concat_ws(' ',sym,event_type,p_name,props) as content,
         concat('https://example.com/',sym,'/',event_id%50) url, ts as "timestamp",
         ts + to_minutes(cast(event_id%90 as integer)) created_at
  from ev),
scored as (
  select event_id, user_id, ts,
         case when event_id%17<>0 then greatest(-10000,least(10000,cast(round((value-50)*100) as bigint)))/1e4 end s,
         {at(WEIGHTS_E2, 'event_id%12')}/1e2 w
  from events),
mentions as (
  select m.* from (
    select 2*event_id id, {sym('user_id')} ticker, event_id article_id, s sentiment, w source_weight, ts created_at from scored
    union all
    select 2*event_id+1, {sym('((user_id+1)%(u+1))')}, event_id, -s, w, ts from scored, latest where event_id%3=0) m
  where ticker in (select symbol from tickers)),
facts as (
  select m.id mention_id, m.ticker, m.article_id, m.sentiment, m.source_weight, a.source, a."timestamp" ts, a.title, a.url
  from mentions m join articles a on a.id=m.article_id),
query_log as (
  select distinct q as query_id, q as query from (
    select case event_id%7
      when 0 then concat({at(SECTOR_QUERIES, 'user_id%10')},' stocks')
      when 1 then concat('$',sym)
      when 2 then concat_ws(' ',sym,'or',{sym('((user_id+1)%(u+1))')})
      when 3 then concat_ws(' ',p_name,'earnings')
      when 4 then p_name
      when 5 then upper(substr(p_name,1,3))
      else concat_ws(' ','latest news on',p_name) end q
    from ev, latest) where q is not null)
"""
