"""The corpus queries op1 to op13, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fill_in_middle, html_text, language, lm, mixing, packing, periodic, quality, simhash, toxicity, urls
from .common import WORD

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file of the token queries, from the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(parts: int) -> Column:
    """The part of a row, by a checksum of its doc_id as text; an absent doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.join(labels, "doc_id"))
    scored = docs.select("doc_id", (fold(5) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op2_mixing", f"""
with d as (select doc_id, source, cast(len({WORDS}) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) - 1 place from d group by source),
w as (select *, list_extract([3e0, 1e0, 2e0], cast(place % 3 + 1 as integer)) weight, 2 * cast(source_size as double) cap from s),
r as (select *, cap / weight need from w),
q as (select *, (1.5e0 * sum(cast(source_size as double)) over ()
          - coalesce(sum(cap) over (order by need, place rows between unbounded preceding and 1 preceding), 0e0))
        / sum(weight) over (order by need, place rows between current row and unbounded following) rate from r),
g as (select *, least(cap, max(case when rate <= need then rate end) over () * weight) target from q),
t as (select *, cast(round(target) as bigint) goal from g),
l as (select d.*, coalesce(sum(size) over (partition by source order by md5(coalesce(cast(doc_id as varchar), '')), size
        rows between unbounded preceding and 1 preceding), 0) start from d)
select doc_id, size, source_size, target, l.source,
       cast(case when source_size = 0 then 0 else (goal // source_size) * size
            + greatest(0, least(size, goal % source_size - start)) end as bigint) taken
from l join t on l.source is not distinct from t.source
""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


@query("op4_urls", r"""
with recursive rules(kind, name, start) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p as (select row_number() over () rid, page_id, url, html,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path,
        case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) end rest from pages),
fit as (select rid, arg_max(struct_pack(rule := name || start, kind := kind), (length(name) + length(start), length(name))) best from p, rules
    where (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by rid),
links as (select url, host, rest, unnest([regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>)', 1),
        '(?is)\bhref\s*=\s*["'']?(https?://[^"''\s>]+)', 1), regexp_extract(regexp_extract(html,
        '(?is)(<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*(https?://[^"''>]+)', 1)]) link
    from p where rest is not null),
edge as (select host || case when rest = '' then '/' else rest end a,
        lower(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(link, '(?s)^.*?://[^/?#]*([^#]*)', 1), ''), '/') b
    from links where link <> ''),
both_ways as (select a, b from edge union select b, a from edge),
reach(node, other) as (select a, b from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.other),
n as (select p.*, best.rule as rule, best.kind own, host || case when rest = '' then '/' else rest end node from p left join fit using (rid)),
known as (select node, min(own) own from n where own is not null and node is not null group by node),
alias as (select node, min(own) own from (select node, own from known union all
    select r.node, k.own from reach r join known k on k.node = r.other) group by node)
select page_id, url, host, path, rule, coalesce(n.own, alias.own, 'allow') verdict from n left join alias on alias.node = n.node
""")
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.declared_links(pages))


@query("op5_quality", rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') text, {WORDS} words from documents),
w as (select rid, unnest(words) word, generate_subscripts(words, 1) i from d),
g as (select *, lead(word, 1) over p next, case when lead(word, 4) over p is not null then concat_ws(' ', word, lead(word, 1) over p,
        lead(word, 2) over p, lead(word, 3) over p, lead(word, 4) over p) end five from w window p as (partition by rid order by i)),
h as (select *, case when five is not null and count(*) over (partition by rid, five) > 1 then 1 else 0 end hit from g),
c as (select *, max(hit) over (partition by rid order by i rows between 4 preceding and current row) covered from h),
a as (select rid, count(*) n_words, sum(length(word)) word_chars, sum(covered) n_repeat_words, count(case when word = next then 1 end) stutter,
        count(case when regexp_matches(word, '\p{{L}}') then 1 end) letters, count(case when word like '%!!' then 1 end) loud from c group by rid),
b as (select doc_id, text, coalesce(n_words, 0) n_words, cast(coalesce(word_chars, 0) as bigint) word_chars,
        cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words, stutter, letters, loud, string_split(text, chr(10)) every_line,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) lines,
        length(text) - length(translate(text, '#*$%&|<>', '')) n_symbols,
        length(text) - length(translate(text, '{quality.CAPITALS}', '')) capitals
      from d left join a using (rid)),
e as (select *, len(lines) - len(list_distinct(lines)) n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from b)
select doc_id, n_words, word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
         or 2 * n_dup_lines > len(every_line) or 10 * letters < 6 * n_words or 2 * loud > n_words or 10 * capitals > 7 * word_chars
         or 3 * stutter > n_words) kept
from e
""")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op6_html")
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def known_languages(docs: DataFrame) -> DataFrame:
    """The rows a language model may learn from."""
    return docs.where(fold(4) != 2)


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and the mixture it comes from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(known_languages(docs))
    found = docs.select("doc_id", (fold(4) == 2).alias("held_out"), language.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.languages", "found.shares")


@query("op8_lm")
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo log-likelihood of every document, and its mean per word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs)
    scored = docs.select("doc_id", lm.score(F.col("text"), model).alias("s")).select("doc_id", "s.n_tokens", "s.score")
    return scored.withColumn("mean_score", F.expr("case when n_tokens > 0 then score / n_tokens end"))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    path = vocabulary()
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a checksum of its doc_id, repeats a stretch of its words from some place on."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    checked = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    repeated = checked.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words")).select(
        "doc_id", "text", "g", "words", F.size("words").cast("long").alias("n"))
    repeated = repeated.withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("case when n > 0 then array_join(transform(sequence(0, int(n) - 1), "
                  "i -> words[int(case when i < a then i else a + (i - a) % p end)]), ' ') else text end")
    return checked.where("h % 10 <> 0").select("doc_id", "text").union(
        repeated.where("h % 10 = 0").select("doc_id", text.alias("text")))


@query("op12_periodic")
def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, some of them planted, and digests of them and of the collapsed text."""
    found = planted(table(spark, sf_dir, "documents")).select("doc_id", periodic.runs(F.col("text")).alias("f")).select("doc_id", "f.*")
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as size, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.size")).alias("length"),
        F.col("longest.period").alias("period"), F.expr("(1000 * -longest.size) div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_fill_in_middle")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's fill-in-the-middle output and of the text restored from it."""
    return fill_in_middle.transform(table(spark, sf_dir, "documents"))
