"""Rules and aliases against a plain reading."""

from tidewatch.llm import urls
from tidewatch.llm.queries import URL_RULES


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x?y#z",
    "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://net/es/1", "http://com", "http://com/", "ftp://b.com?x=/en/",
    "http://notexample.com/en/", "http://a.org/x://b.com/", "http://ß.NET/es/", "http://x.org/en/", "http://y.org#://z.com/",
]


def test_rules(spark):
    rows = [(i, u, "<p>", "h", "v") for i, u in enumerate(URLS)] + [(4, URLS[4], None, None, None), (None, URLS[7], "", "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    got = urls.judge(pages, URL_RULES, urls.declared_links(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    kept = urls.allowed(pages, URL_RULES, urls.declared_links(pages))
    assert kept.columns == pages.columns and kept.count() == sum(r.verdict == "allow" for r in got)


def test_aliases(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head>'
    pages = spark.createDataFrame([
        (1, "http://a.org/1", link.format("https://x.net/es/1")),  # blocked at one step
        (2, "http://b.org/1", '<meta http-equiv="Refresh" content="0; url=http://a.org/1">'),  # at two
        (3, "http://c.org/1", link.format("//b.org/1")),
        (4, "http://d.org/1", link.format("http://e.org/a")),  # one alias blocked, one allowed
        (5, "http://e.org/a", link.format("http://x.net/fr/a")),
        (6, "http://f.com/a", link.format("/other")), (7, "http://f2.org/a", link.format("http://f.com/other?x=1&amp;y=2")),
        (8, "https://g.org/p/q", link.format("r")), (9, "http://g.org/p/r#top", "<p>canonical</p>"),
        (10, "http://e.org/b", link.format("http://e.org/a")), (11, "http://h.com/z", link.format("http://e.org/b")),
        (12, "http://a.org/2", link.format("mailto:me")), (13, "http://a.org/3", link.format("")), (14, None, link.format("http://x.net/es/1")),
    ], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, URL_RULES, urls.declared_links(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow",
                   10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow"}
    found = {tuple(r) for r in urls.declared_links(pages).where("url like '%g.org%' or url like '%f2%'").collect()}
    assert found == {("https://g.org/p/q", "https://g.org/p/r"), ("http://f2.org/a", "http://f.com/other?x=1&y=2")}


def test_long_chain_and_hub(spark):
    chain = [(f"http://c{i}.org/", f"http://c{i + 1}.org/") for i in range(60)] + [("http://c60.org/", "http://z.net/es/1")]
    hub = [(f"http://h{i}.org/", "http://z.net/fr/hub") for i in range(200)]
    links = spark.createDataFrame(chain + hub + chain[:5] + [("http://c0.org/", None)], "url string, alias string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(chain + hub + [("http://free.org/", "")])], "page_id long, url string")
    got = {r.url: r.verdict for r in urls.judge(pages, URL_RULES, links).collect()}
    assert got.pop("http://free.org/") == "allow" and set(got.values()) == {"block"}


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty, URL_RULES, urls.declared_links(empty)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert urls.judge(empty, none, urls.declared_links(empty)).count() == 0


def test_many_rules_and_tables(spark, monkeypatch):
    """Joined rules judge like those of one expression, and like a plain reading."""
    rules = [*URL_RULES, ("allow", "", ""), ("block", "c.b.a", "/x"), ("allow", "b.a", "/x/y"), ("block", "a", ""), ("allow", "a", "/x/y/z")]
    hosts = ["a", "b.a", "c.b.a", "d.c.b.a", "xa", "", "a."]
    more = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/x", "/x/y", "/x/y/z?q", "/é/x"))]
    pages = spark.createDataFrame([(1000 + i, u, f'<link rel="canonical" href="{URLS[9]}">') for i, u in enumerate(URLS)] + more,
                                  "page_id long, url string, html string")
    links = urls.declared_links(pages)
    want = sorted(map(str, urls.judge(pages, rules, links).collect()))
    table = spark.createDataFrame(rules + rules[:3], "verdict string, host string, path string")
    assert sorted(map(str, urls.judge(pages, table, links).collect())) == want
    monkeypatch.setattr(urls, "MAX_RULES", 3)
    assert sorted(map(str, urls.judge(pages, rules, links).collect())) == want
    monkeypatch.undo()
    many = [("block" if i % 2 else "allow", f"h{i}.net", f"/{i % 7}/") for i in range(3 * urls.MAX_RULES)]
    some = spark.createDataFrame([(i, f"https://www.h{i}.net/{i % 5}/page") for i in range(0, 3000, 11)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(some, many, spark.createDataFrame([], "url string, alias string")).collect()}
    for i, (rule, verdict) in got.items():
        assert (rule, verdict) == ((f"h{i}.net/{i % 5}/", "block" if i % 2 else "allow") if i % 7 == i % 5 else (None, "allow"))
