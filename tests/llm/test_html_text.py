"""Main texts of hand-written and supplied pages."""

import html
import os
import re

import pytest

from tidewatch.llm import html_text

FOLDER = "/root/testdata/sf0.01"
STORY = "<h1>Title here</h1><p>First <b>bold</b> part &amp; more,\n  with   space.<br>After break<p>Second one, long enough to count.</p><ul><li>item a<li>item b</ul>"
WANT = "Title here\nFirst bold part & more, with space. After break\nSecond one, long enough to count.\nitem a\nitem b"


def page(story=STORY, holder="article", before="", after=""):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style><script>var a = '<p>x</p>';</script></head><body>"
        f"<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav><div class=cookie-notice>We use cookies</div>{before}"
        f"<{holder}>{story}</{holder.split()[0]}><aside>Side</aside><form><p>Search <input></form>{after}<footer>(c) us</footer></body></html>")


CASES = {
    "plain": (page(), WANT),
    "div": (page(holder='div class="post-body 17"'), WANT),
    "inner outer parts": (page(STORY + '<div class="ad">buy</div><section id="comments"><p>I disagree</p></section>'), WANT),
    "cut off": (page().split("</article>")[0], WANT),
    "comment": (page("<!-- <p>no</p> -->" + STORY), WANT),
    "hidden": (page(STORY + '<p hidden>no</p><p style="display: none">no</p>'), WANT),
    "references": (page("<p>a&lt;b&gt; &#233;&#x41; &nbsp;x &unknown; 1 < 2</p>" + "<p>" + "w " * 50 + "</p>"),
                   "a<b> éA x &unknown; 1 < 2\n" + ("w " * 50).strip()),
    "links outside": (page(before="<div>" + '<a href="/x">many words in links</a> ' * 30 + "</div>"), WANT),
    "no markup": ("just text", "just text"), "empty": ("", ""), "absent": (None, ""), "no text": ("<div><img src=a></div>", ""),
    "broken": ("<p>a<div <p>b</p>", None), "quote": ('<p title="a>b">kept</p>', "kept"),
    "two columns": (page("<section><p>" + "one " * 40 + "</p></section><section><p>" + "two " * 40 + "</p></section>"),
                    ("one " * 40).strip() + "\n" + ("two " * 40).strip()),
}


@pytest.mark.parametrize("name", list(CASES))
def test_single_page(name):
    source, want = CASES[name]
    read = html_text.Page(source)
    text = read.text(read.best()[0])
    assert want is None or text == want


def test_consensus(spark):
    """A page whose comments outweigh its story follows the other pages of its host."""
    odd = page("<p>Short story.</p>", 'div class="story 4"', after='<div class="talk"><p>' + "chatter " * 80 + "</p></div>")
    rows = [(i, "http://h.org/", page(f"<p>{'words ' * (30 + i)}</p>", f'div class="story {i}"')) for i in range(6)]
    rows += [(6, "http://h.org/x", odd), (7, "http://other.org/", odd), (8, None, page()), (8, None, page()), (None, "http://h.org/", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[6] == "Short story." and by_id[7].startswith("chatter") and by_id[8] == WANT and by_id[None] == ""


def test_long_page_and_empty_table(spark):
    long = page("".join(f"<p>paragraph {i}</p>" for i in range(20_000)))
    assert html_text.Page(long).text(html_text.Page(long).best()[0]).count("\n") == 19_999
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert html_text.Page(deep).text(html_text.Page(deep).best()[0]) == "deep"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_supplied_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {}
    for r in pages.collect():
        story = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", story))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


PROSE = [f"<p>{(word + ' ') * 40}</p>" for word in ("one", "two", "three", "four", "five")]
WHOLE = "\n".join(((word + " ") * 40).strip() for word in ("one", "two", "three", "four", "five"))
PARTS = "<{0}>" + "".join(PROSE[:3]) + "</{1}><{2}>" + "".join(PROSE[3:]) + "</{3}>"
HELD = {
    "wrap": page("".join(PROSE), 'div class="content-sidebar-wrap"'), "main": page("".join(PROSE), 'main class="has-sidebar"'),
    "article": page("".join(PROSE), 'article class="post has-comments"'), "most": page("".join(PROSE), "div class=sidebar-left"),
    "no container": "<body>" + "".join(PROSE[:-1]) + "<p class=has-share>" + PROSE[-1][3:] + "</body>",
    "two parts": page(PARTS.format("div class=a", "div", "div class=b", "div"), "div class=wrap"),
    "two levels": page("<div>" + PARTS.format("section class=a", "section", "section class=b", "section") + "</div>"),
    "comments": page("".join(PROSE) + '<div class="post-comments"><p>' + "no " * 60 + "</p></div>"),
}


@pytest.mark.parametrize("name", list(HELD))
def test_whole_article(name):
    read = html_text.Page(HELD[name])
    assert read.text(read.best()[0]) == WHOLE


LONG = " ".join(f"Reader number {i} thinks otherwise and says so at length." for i in range(14))
ARTICLE = "A short report of what happened, in two sentences. It ends here, after some more words to be sure of it."


def test_outer_parts_go_at_any_length():
    comments = f"<div class=comments><p>{LONG}</p></div>"
    for page in (
        f"<body><div class=content><p>{ARTICLE}</p></div>{comments}</body>",
        f"<body><article><p>{ARTICLE}</p>{comments}</article></body>",
        f"<body><div class=post><p>{ARTICLE}</p></div><div class='cookie-notice'><p>{LONG}</p></div></body>",
        f"<body><main><p>{ARTICLE}</p></main><div class=sidebar><p>{LONG}</p></div></body>",
        f"<body><div class='sidebar-left'><p>{ARTICLE}</p>{comments}</div></body>",
        f"<body><div class='sidebar-left'><p>{ARTICLE}</p></div><div class='newsletter'><p>{LONG}</p></div></body>",
    ):
        parsed = html_text.Page(page)
        assert parsed.text(parsed.best()[0]) == ARTICLE, page
    assert html_text.Page(f"<body>{comments}</body>").blocks == []


def test_one_page_has_one_vote(spark):
    """A page of another layout, longer than all others together, doesn't outvote its host."""
    page = "<body><div class=body><p>This is the report, long enough to outweigh what stands below. Number {}.</p></div><div class=extra><p>Tiny.</p></div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(i)) for i in range(5)]
    rows.append((9, "https://h.example/9", f"<body><div class=extra><p>{LONG * 20}</p></div></body>"))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(f"Number {i}.") for i in range(5)) and got[9] == (LONG * 20).strip()


def generated(rng, style):
    """A page and its main text, known from the making."""
    word = lambda n: " ".join(rng.choice(["river", "stone", "light", "of", "the", "and", "seldom", "carries", "&amp;", "wind"], n))
    paragraphs = [word(rng.integers(12, 60)) + "." for _ in range(rng.integers(1, 8))]
    holder = ("article", "div class='post-body'", "main id=content", "section class=story")[style % 4]
    end = holder.split()[0]
    outer = [
        f"<nav><ul><li><a href=/>{word(3)}</a></li></ul></nav>", f"<div class='side-bar sidebar'><p>{word(rng.integers(5, 200))}</p></div>",
        f"<div id=comments><div class=comment><p>{word(rng.integers(5, 400))}</p></div></div>", f"<footer><p>{word(20)}</p></footer>",
        f"<div class=cookie-banner><p>{word(rng.integers(5, 300))}</p></div>", f"<form><p>{word(9)}</p></form>", f"<script>var x = '<p>{word(5)}</p>';</script>",
        f"<div class=advert><p>{word(rng.integers(5, 100))}</p></div>", f"<header><h1>{word(4)}</h1></header>"]
    rng.shuffle(outer)
    inner = [f"<p>{p}</p>" for p in paragraphs]
    inner.insert(int(rng.integers(0, len(inner) + 1)), outer.pop())
    at = int(rng.integers(0, len(outer)))
    body = "\n".join([*outer[:at], f"<{holder}>{''.join(inner)}</{end}>", *outer[at:]])
    return f"<html><head><title>{word(3)}</title></head><body>{body}</body></html>", "\n".join(p.replace("&amp;", "&") for p in paragraphs)


def test_generated_pages(spark):
    import numpy as np
    rng = np.random.default_rng(12)
    made = [(i, f"https://host{i % 4}.example/p{i}", *generated(rng, i % 4)) for i in range(120)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string")).collect()}
    assert [i for i, *_, text in made if got[i] != text] == []
