"""Text functions, extraction, signatures and near-duplicates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch import session
from tidewatch.functions import minhash, scores, text, vocab
from tidewatch.operators import dedup, extract, maintenance, models

from .catalog import inlist, query, r4
from .views import Views

WORD = "[\\p{L}\\p{N}_]+"


def shingle_sql(name: str, source: str, id_col: str, body: str) -> str:
    """Table (id, s): the set of word 3-shingles of each text."""
    return f""",
 {name}_tok as (select {id_col} id, regexp_extract_all(lower({body}),'{WORD}') t from {source}),
 {name} as (select distinct id, s from (
   select id, unnest(case when len(t)<3 then [array_to_string(t,' ')]
     else list_transform(range(1,len(t)-1), lambda i: concat_ws(' ',t[i],t[i+1],t[i+2])) end) s from {name}_tok))"""


def signature_sql(name: str, source: str, id_col: str, body: str) -> str:
    """Table (id, i, v): signature position i of each text."""
    return shingle_sql(f"{name}_s", source, id_col, body) + f""",
 perms as (select i, cast(('0x'||substr(md5(concat('a',i)),1,8)) as bigint)%2147483646+1 a,
                  cast(('0x'||substr(md5(concat('b',i)),1,8)) as bigint)%2147483646+1 b from range({vocab.NUM_PERM}) r(i)),
 {name}_h as (select id, cast(('0x'||substr(md5(s),1,8)) as bigint)%2147483647 h from {name}_s),
 {name} as (select id, i, min((h*a+b)%2147483647) v from {name}_h, perms group by 1,2)"""


def documents(v: Views):
    return session.spread(v.table("documents"))


def signed(v: Views):
    """Documents with their signatures."""
    return documents(v).select(F.col("doc_id").alias("id"), minhash.signature("text").alias("minhash_signature"))


@query("shingles", shingle_sql("sh", "documents", "doc_id", "text") + """
 select id doc_id, count(*) n, md5(string_agg(s,'|' order by s)) digest from sh group by 1""")
def shingles(v: Views):
    sets = documents(v).select("doc_id", text.shingles("text").alias("s"))
    return sets.select("doc_id", F.size("s").cast("bigint").alias("n"),
                       F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query("minhash_signature", signature_sql("sig", "documents", "doc_id", "text") + """
 select id doc_id, md5(string_agg(cast(v as varchar),',' order by i)) digest from sig group by 1""")
def minhash_signature(v: Views):
    joined = F.array_join(F.col("minhash_signature").cast("array<string>"), ",")
    return signed(v).select(F.col("id").alias("doc_id"), F.md5(joined).alias("digest"))


def edges_sql(source: str, id_col: str, body: str) -> str:
    """Table alike (later, earlier): pairs of texts whose signatures reach the threshold."""
    return signature_sql("sig", source, id_col, body) + f""",
 alike as (select a.id later, b.id earlier from sig a join sig b on a.i=b.i and a.v=b.v and a.id>b.id
             group by 1,2 having count(*)>={minhash.needed_matches(vocab.NEAR_DUP_THRESHOLD)})"""


EDGES = edges_sql("documents", "doc_id", "text")
# The rule "keep unless an earlier kept text is alike", in the order of the ids.
WALK = """,
 nodes as (select id, row_number() over (order by id) rn, nb from (
   select id, list(e) filter (where e is not null) nb from (
     select later id, earlier e from alike union all select earlier, null from alike) group by 1)),
 walk as (select cast(0 as bigint) rn, cast([] as bigint[]) kept
   union all select n.rn, case when n.nb is not null and list_has_any(w.kept, n.nb) then w.kept else list_append(w.kept, n.id) end
   from walk w join nodes n on n.rn=w.rn+1),
 final as (select kept from walk order by rn desc limit 1)"""


@query("near_dup_kept", EDGES + WALK + """
 select doc_id, doc_id not in (select id from nodes) or list_contains((select kept from final), doc_id) kept from documents""")
def near_dup_kept(v: Views):
    verdicts = dedup.greedy_verdicts(signed(v), [])
    return verdicts.select(F.col("id").alias("doc_id"), "kept")


@query("near_duplicates", signature_sql("sig", "documents", "doc_id", "text") + f""",
 old as (select distinct doc_id id from labels),
 alike as (select a.id later, b.id earlier from sig a join sig b on a.i=b.i and a.v=b.v
             where a.id not in (select id from old) and b.id in (select id from old)
             group by 1,2 having count(*)>={minhash.needed_matches(vocab.NEAR_DUP_THRESHOLD)})
 select distinct later doc_id from alike""")
def near_duplicates(v: Views):
    """Unlabelled documents that copy a labelled one."""
    sigs, old = session.durable(signed(v)), v.table("labels").select(F.col("doc_id").alias("id")).distinct()
    found = dedup.near_duplicates(sigs.join(old, "id", "left_anti"), sigs.join(old, "id", "left_semi"))
    return found.select(F.col("id").alias("doc_id"))


TURNS = """, turns as (select concat(conv_id,'-',turn) k, concat(conv_id,'-',turn+1) nk, text from conversations)"""


@query("exact_jaccard", TURNS + shingle_sql("sh", "turns", "k", "text") + """,
 pairs as (select a.k earlier, a.nk later from turns a where a.nk in (select k from turns)),
 n as (select id, count(*) c from sh group by 1),
 common as (select p.later, p.earlier, count(*) c from pairs p join sh a on a.id=p.earlier join sh b on b.id=p.later and b.s=a.s group by 1,2)
 select p.later, p.earlier, """ + r4("coalesce(c.c,0)/cast(x.c+y.c-coalesce(c.c,0) as double)") + """ jaccard
 from pairs p join n x on x.id=p.earlier join n y on y.id=p.later left join common c on c.later=p.later and c.earlier=p.earlier""")
def exact_jaccard(v: Views):
    """Each turn of a conversation against the one before."""
    turns = session.spread(v.table("conversations")).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1).alias("next"), "text")
    pairs = turns.select(F.col("next").alias("later"), F.col("id").alias("earlier")).join(
        turns.select(F.col("id").alias("later")), "later", "left_semi")
    return dedup.exact_jaccard(pairs, turns, "id", "text").withColumn("jaccard", scores.round4("jaccard"))


@query("jaccard_estimate", TURNS + signature_sql("sig", "turns", "k", "text") + """,
 pairs as (select a.k earlier, a.nk later from turns a where a.nk in (select k from turns))
 select p.later, p.earlier, sum(case when a.v=b.v then 1 else 0 end)/128e0 estimate
 from pairs p join sig a on a.id=p.earlier join sig b on b.id=p.later and b.i=a.i group by 1,2""")
def jaccard_estimate(v: Views):
    turns = session.spread(v.table("conversations")).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1).alias("next"), minhash.signature("text").alias("sig"))
    a = turns.select(F.col("id").alias("earlier"), F.col("next").alias("later"), F.col("sig").alias("a"))
    b = turns.select(F.col("id").alias("later"), F.col("sig").alias("b"))
    return a.join(b, "later").select("later", "earlier", minhash.jaccard_est(F.col("a"), F.col("b")).alias("estimate"))


@query("minhash_backfill", signature_sql("sig", "documents", "doc_id", "text") + """
 select id, case when id in (select doc_id from labels) then md5('kept') else md5(string_agg(cast(v as varchar),',' order by i)) end digest
 from sig group by 1""")
def minhash_backfill(v: Views):
    """Labelled documents count as already signed and keep their signature."""
    labelled = v.table("labels").select("doc_id", F.lit(True).alias("done")).distinct()
    docs = documents(v).join(labelled, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"),
        F.when(F.col("done"), F.array(F.lit(7))).alias("minhash_signature"))
    filled = maintenance.backfill_minhash(docs)
    joined = F.array_join(F.col("minhash_signature").cast("array<string>"), ",")
    return filled.select("id", F.when(joined == "7", F.md5(F.lit("kept"))).otherwise(F.md5(joined)).alias("digest"))


@query("title_keys", """select id, lower(trim(regexp_replace(title,'\\s+-\\s+[^-]+$',''))) title_key,
  concat('article-',substr(md5(concat(source,'||',url)),1,12)) stable from articles""")
def title_keys(v: Views):
    return v.articles.select("id", text.title_key("title").alias("title_key"),
                             text.stable_id("article", "source", "url").alias("stable"))


@query("compose_text", """select id, md5(concat(title,' ',content)) whole, md5(substr(concat(title,e'\\n\\n',content),1,40)) cut from articles""")
def compose_text(v: Views):
    return v.articles.select(
        "id", F.md5(text.compose_text("title", "content")).alias("whole"),
        F.md5(text.compose_text("title", "content", 40, "\n\n")).alias("cut"))


SYMBOLS = f"""select distinct id, symbol from (select id, ltrim(unnest(regexp_extract_all(title,'\\$[A-Z]{{2,5}}\\b|\\b[A-Z]{{2,5}}\\b')),'$') symbol from articles)
  where symbol in (select symbol from tickers) and symbol not in {inlist(vocab.ARTICLE_STOPWORDS)}"""


@query("extract_symbols", SYMBOLS)
def extract_symbols(v: Views):
    return extract.extract_symbols(v.articles, v.tickers)


LEGAL = "\\b(" + "|".join(vocab.LEGAL_SUFFIXES) + ")\\b\\.?"
KEYWORDS = f""", cleaned as (select symbol, regexp_replace(regexp_replace(company_name,'{LEGAL}',' ','gi'),'[^A-Za-z0-9 ]',' ','g') c from tickers),
 kw as (select distinct symbol, w from (select symbol, unnest(string_split_regex(lower(c),' +')) w from cleaned)
   where length(w)>=4 and w not in {inlist(vocab.KEYWORD_BLOCKLIST)})"""


@query("company_keywords", KEYWORDS + """ select t.symbol, coalesce(string_agg(w,'|' order by length(w) desc, w),'') keywords
  from tickers t left join kw on kw.symbol=t.symbol where company_name is not null group by 1""")
def company_keywords(v: Views):
    named = v.tickers.filter("company_name is not null")
    return named.select("symbol", F.array_join(text.company_keywords("company_name"), "|").alias("keywords"))


BY_COMPANY = f"""select distinct a.id, kw.symbol from (
  select distinct id, unnest(regexp_extract_all(lower(title),'{WORD}')) w from articles) a join kw on kw.w=a.w"""


# one digest per article: a common word names many companies
@query("extract_by_company", KEYWORDS + f""" select id, count(*) n, md5(string_agg(symbol, '|' order by symbol)) symbols from ({BY_COMPANY}) group by 1""")
def extract_by_company(v: Views):
    return per_article(*extract.ticker_classes(v.articles, v.tickers, by_symbol=False))


def per_article(members, classes):
    """Number and digest of the symbols of each article, made once per class."""
    digest = F.md5(F.array_join(F.array_sort(F.collect_list("symbol")), "|")).alias("symbols")
    return members.join(classes.groupBy("class").agg(F.count("*").alias("n"), digest), "class").select("id", "n", "symbols")


@query("extract_tickers", KEYWORDS + f""" select id, count(*) n, md5(string_agg(symbol, '|' order by symbol)) symbols from (
  select id, symbol from ({BY_COMPANY}) union select id, symbol from ({SYMBOLS})) group by 1""")
def extract_tickers(v: Views):
    return per_article(*extract.ticker_classes(v.articles, v.tickers))


# Model hooks with the deterministic stand-ins

def toy_recogniser(texts: list[str]) -> list[list[tuple[str, str]]]:
    """Test stand-in: the first word is a ticker, the third an organisation."""
    out = []
    for t in texts:
        w = t.split()
        out.append([("TICKER", w[0]), ("ORG", " ".join(w[2:3]))] if len(w) > 2 else [])
    return out


@query("recognise", KEYWORDS + """, parts as (select id, string_split(content,' ') p from articles),
 cand as (select id, p[1] c from parts where len(p)>2 union all select id, p[3] from parts where len(p)>2),
 words as (select distinct id, unnest(regexp_extract_all(lower(c),'[\\p{L}\\p{N}_]+')) w from cand where not regexp_matches(upper(c),'^[A-Z]{1,5}$'))
 select id, upper(c) symbol from cand where regexp_matches(upper(c),'^[A-Z]{1,5}$') and upper(c) in (select symbol from tickers)
 union select words.id, kw.symbol from words join kw on kw.w=words.w""")
def recognise(v: Views):
    candidates = extract.recognise(v.articles, toy_recogniser)
    return extract.resolve_candidates(candidates, v.tickers)


def _count(words) -> str:
    return "+".join(f"(length(a)-length(replace(a,'{w}','')))/{len(w)}e0" for w in words)


@query("score_mentions", f""", judged as (select article_id, ticker, {_count(models.LexiconScorer.GOOD)} g, {_count(models.LexiconScorer.BAD)} b
   from (select m.article_id, m.ticker, lower(concat(title,e'\\n\\n',content)) a from mentions m join articles on articles.id=m.article_id))
 select article_id, ticker, true is_relevant, case when g+b>0 then {r4('(g-b)/(g+b)')} else 0e0 end sentiment,
   concat(ticker,': ',cast(g as bigint),'/',cast(b as bigint)) summary from judged""")
def score_mentions(v: Views):
    """The lexicon stand-in judges every (article, ticker) pair."""
    pairs = v.mentions.select("article_id", "ticker").join(
        v.articles.select(F.col("id").alias("article_id"), text.compose_text("title", "content", sep="\n\n").alias("article_text")),
        "article_id")
    return models.score_mentions(pairs, models.LexiconScorer())


def hashing_encoder(texts: list[str]) -> np.ndarray:
    """Test stand-in for a sentence encoder: letter counts by position."""
    out = np.zeros((len(texts), 32))
    for row, t in zip(out, texts):
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        row += np.bincount(codes % 32, minlength=32)
    return out


LETTERS = """, letters as (select doc_id id, unicode(unnest(string_split(text,''))) %32 d from documents),
 counted as (select id, d, count(*) n from letters group by 1,2),
 vec as (select doc_id id, md5(string_agg(cast(floor(cast(cast(coalesce(n,0)/norm as float) as double)*1e4+0.5e0) as bigint), ',' order by r.d)) x
   from documents, range(32) r(d) join (select id, sqrt(sum(n*n)) norm from counted group by 1) s on true
   left join counted c on c.id=doc_id and c.d=r.d where s.id=doc_id group by 1)"""


def places(column: str):
    """A digest of all numbers of a vector, to four places."""
    return F.md5(F.array_join(F.transform(column, lambda x: F.floor(x.cast("double") * 1e4 + 0.5).cast("bigint").cast("string")), ","))


@query("embed", LETTERS + " select id doc_id, 32 dim, x vector from vec")
def embed(v: Views):
    docs = models.embed(documents(v), hashing_encoder)
    return docs.select("doc_id", F.size("embedding").alias("dim"), places("embedding").alias("vector"))


@query("embedding_backfill", LETTERS + """ select id, case when id in (select doc_id from labels) then md5('10000') else x end as vector from vec""")
def embedding_backfill(v: Views):
    done = v.table("labels").select("doc_id", F.lit(True).alias("done")).distinct()
    docs = documents(v).join(done, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"),
        F.when(F.col("done"), F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return maintenance.backfill_embeddings(docs, hashing_encoder).select("id", places("embedding").alias("vector"))
