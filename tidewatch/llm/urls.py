"""URL rules with redirect equivalence, in DataFrame operations only.

A URL that no rule fits inherits the decisions of its aliases: addresses joined
to it by redirects and canonical links, over any number of steps.  An explicit
allow among the aliases outweighs a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import components, join_skewed
from tidewatch.session import durable

from .common import fresh

Rule = tuple[str, str, str]  # verdict, host, path

#: Rules that one expression may hold, as they are part of the plan; more of them, or a table, are joined, with the same result.
MAX_RULES = 1000
AFTER_HOST = r"(?s)^.*?://[^/?#]*"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, in lower case; empty without a ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, AFTER_HOST + r"([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The form under which URLs are the same page: no scheme, no fragment; NULL without a ://."""
    rest = F.regexp_extract(url, AFTER_HOST + r"([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or one of its parents and starts the path; NULLs without one."""
    text = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(start))
        text, verdict = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def ruled(rows: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """`rows` of (host, path, ...) with `rule` and `own`, as rule_of() finds them.

    Many rules, or a table of (verdict, host, path), meet the different hosts and
    paths by equality: of each host all parents, of each path the beginnings that
    are as long as some rule's path.  Of rules for one host and path the last of
    a list counts; in a table an allow counts.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_RULES:
        text, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": text, "own": verdict})
    if not isinstance(rules, DataFrame):
        last = {(name, start): kind for kind, name, start in rules}
        rules = rows.sparkSession.createDataFrame([(kind, *key) for key, kind in last.items()], "verdict string, host string, path string")
    table = durable(rules.where("host is not null and path is not null").groupBy(
        F.col("host").alias("name"), F.col("path").alias("start")).agg(F.min("verdict").alias("kind")))
    lengths = [r[0] for r in table.select(F.length("start")).distinct().collect()]  # at most as many as the longest path has characters
    met = rows.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    names = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    starts = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substr(F.col("path"), F.lit(1), n)))
    keys = met.select("host", "path", F.explode(names).alias("name"), starts.alias("starts")).select(
        "host", "path", "name", F.explode("starts").alias("start"))
    size = F.length("name") + F.length("start")
    found = keys.join(table, ["name", "start"]).groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("name", "start").alias("rule"), "kind"), F.struct(size, F.length("name"))).alias("best"))
    pair = F.to_json(F.struct("host", "path"))
    (key,) = fresh(rows, "host_path")
    best = found.select(pair.alias(key), F.col("best.rule").alias("rule"), F.col("best.kind").alias("own"))
    return join_skewed(rows.withColumn(key, pair), best, key, "left").drop(key)


def resolved(link: Column, base: Column) -> Column:
    """The absolute form of a link found on the page `base`; NULL for an empty link or other schemes."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    link = F.trim(link)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when((link == "") | F.startswith(link, F.lit("#")) | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def declared_links(pages: DataFrame) -> DataFrame:
    """(url, alias): where a page says that it really lives, by a canonical link or a refreshing redirect."""
    tag = lambda name, having: F.regexp_extract("html", rf"(?is)(<{name}\b[^>]*?\b{having}[^>]*>)", 1)
    canonical = F.regexp_extract(tag("link", r"rel\s*=\s*[\"']?canonical\b"), r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    refresh = F.regexp_extract(tag("meta", r"http-equiv\s*=\s*[\"']?refresh\b"), r"(?is)\burl\s*=\s*([^\"'>]+)", 1)
    value = F.trim(F.regexp_replace(F.regexp_replace(canonical, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", ""))
    plain = lambda x: F.regexp_replace(x, "&amp;", "&")
    wanted = pages.where("url is not null and html is not null").where(
        F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("http-equiv")))
    both = wanted.select("url", F.explode(F.array(plain(value), plain(refresh))).alias("link"))
    return both.select("url", resolved(F.col("link"), F.col("url")).alias("alias")).where("alias is not null")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, links: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of (page_id, url, ...) with host, path, rule and verdict, and no other column than page_id and url.

    `links` holds (url, alias) pairs from redirects and canonical links.  URLs
    that differ in scheme or fragment alone are the same page.  Without a rule
    of its own, a page is allowed if a rule allows any of its aliases, else
    blocked if one blocks any, else `default`.  Aliases need not be pages of the
    table.  NULL urls and urls without :// have empty host and path, no rule and
    no alias.  Repeated rows are judged alike; empty tables give empty results.
    Decisions are reduced per component before they meet the pages.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = ruled(rows, rules).withColumn("node", address(F.col("url")))
    named = links.select(F.col("url").alias("x"), F.col("alias").alias("y"))
    edges = durable(named.select(address(F.col("x")).alias("a"), address(F.col("y")).alias("b")).where("a is not null and b is not null").distinct())
    roots = components(edges)
    # what rules say about every known address: the pages' and those that only links name
    linked = named.select(F.explode(F.array("x", "y")).alias("url"))
    linked = linked.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    decided = rows.select("node", "own").union(ruled(linked, rules).select(address(F.col("url")), "own")).where("own is not null and node is not null")
    by_node = decided.groupBy("node").agg(F.min("own").alias("own"))  # allow sorts before block
    by_root = by_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("own").alias("alias_verdict"))
    placed = join_skewed(rows, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = join_skewed(placed, by_root, "root", "left")
    return met.select("page_id", "url", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: Sequence[Rule] | DataFrame, links: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of `pages` that judge() allows, with all their columns."""
    key, missing = fresh(pages, "url_key", "url_missing")
    shown = judge(pages.select(F.lit(0).alias("page_id"), "url"), rules, links, default).where("verdict = 'allow'")
    keys = shown.select(F.coalesce("url", F.lit("")).alias(key), F.col("url").isNull().alias(missing)).distinct()
    out = pages.withColumns({key: F.coalesce("url", F.lit("")), missing: F.col("url").isNull()}).join(keys, [key, missing], "left_semi")
    return out.select(*(F.col(f"`{c}`") for c in pages.columns))
