"""Main text of web pages by the consensus of their host.

Each page nominates the container that holds most of its running text.  The
pages of a host vote on the container's path of generalised tags and classes,
and every page of the host is extracted again along the winning path.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import join_skewed
from tidewatch.session import durable

from .common import small
from .urls import host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe|template|svg|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][\w:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[A-Za-z][^>]*>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold blocks, and so can be the main container.
HOLDERS = frozenset("html body main article section div center table tbody tr td blockquote figure details ul ol dl".split())
#: Elements that are one block each.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th pre caption figcaption summary address legend hr".split())
#: Elements that hold no main text.
OUTER = frozenset("head nav header footer aside form menu button select option dialog fieldset object audio video canvas".split())
BLOCKS = HOLDERS | LEAVES | OUTER
OUTER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement banner sponsor sponsored"
    " promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing social related"
    " recommended breadcrumb breadcrumbs comment comments disqus reply replies login signup search pagination pager toolbar"
    " copyright hidden navigation contentinfo complementary alert dialog".split())
#: Outer words that layouts also give to what holds the whole article.
LAYOUT_WORDS = frozenset("header sidebar aside social share related search hidden toolbar complementary".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
#: Words before an outer word, and around it, that speak of an element which holds or lacks the outer part.
HOLDING, LAST = frozenset("has have with no without".split()), frozenset("wrap wrapper container".split())
#: A container gives way to an ancestor that holds this part more of running text.
MORE = 1 / 8


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _outer(value: str) -> bool:
    """Whether a class, id or role names an outer part, and not an element that holds or lacks one."""
    for name in value.split():
        words = _words(name)
        if words and words[0] in ("content", "main") and words[-1] in LAST:
            continue
        if any(w in OUTER_WORDS and not (i and words[i - 1] in HOLDING) for i, w in enumerate(words)):
            return True
    return False


def _attributes(rest: str) -> tuple[str, list[str], bool, bool]:
    """Generalised classes, the words of class, id and role, whether they name an outer part, and whether the element is hidden."""
    classes, words, outer, hidden = "", [], False, False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words += _words(value)
            outer |= _outer(value)
            if name == "class":
                classes = "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(value.lower().split())))
    return classes, words, outer, hidden


class Page:
    """Containers and text blocks of one page, without its outer parts.

    What its class, id or role calls an outer part is left out at any length.
    Only a page that would have no running text at all keeps such parts, of
    those that are called by a word of layouts; comments, notices, adverts,
    menus and forms are left out from every page.
    """

    def __init__(self, source: str | None):
        self.parent, self.path, self.weight = [-1], [""], [1]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        named: dict[int, tuple[bool, bool]] = {}  # nodes that a word calls outer parts: may they be containers, is it a layout's word
        stack: list[tuple[str, int]] = []  # element, its container or -1 within outer parts
        pieces: list[str] = []
        linked = depth = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                node = stack[-1][1] if stack else 0
                text = " ".join(entities.unescape("".join(pieces)).split()) if node >= 0 else ""
                if text:
                    self.blocks.append((node, text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def close(name: str) -> None:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    return

        for m in TOKEN.finditer(source or ""):
            kind = m.lastgroup
            if kind == "text":
                pieces.append(m[0])
                linked += len(m[0]) if depth else 0
                continue
            if not m["name"]:
                continue
            name = m["name"].lower()
            if name == "a":
                depth = 0 if m["end"] else 1
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCKS:
                flush()
                if m["end"]:
                    close(name)
                    continue
                if stack and stack[-1][0] in LEAVES and (stack[-1][0] not in ("li", "dd") or name == stack[-1][0]):
                    stack.pop()
                if name == "body":
                    close("head")
                classes, words, outer, hidden = _attributes(m["rest"]) if m["rest"].strip() else ("", [], False, False)
                node = stack[-1][1] if stack else 0
                outer &= name not in ("html", "body", "article", "main")
                if node >= 0 and (name in OUTER or hidden):
                    node = -1
                elif node >= 0 and (outer or name in HOLDERS):
                    if outer:
                        named[len(self.path)] = name in HOLDERS, OUTER_WORDS.intersection(words) <= LAYOUT_WORDS
                    self.parent.append(node)
                    self.path.append(f"{self.path[node]}>{name}{classes}")
                    self.weight.append(6 if name in ("article", "main") else 3 if MAIN_WORDS.intersection(words) else 2)
                    node = len(self.path) - 1
                if name not in VOID and not m["rest"].endswith("/"):
                    stack.append((name, node))
        flush()
        if named:
            self._leave_out(named)

    def _running(self) -> list[int]:
        """The running text within each container."""
        total = [0] * len(self.path)
        for node, text, linked in self.blocks:
            total[node] += max(0, len(text) - 3 * linked)
        for node in range(len(total) - 1, 0, -1):  # parents come first
            total[self.parent[node]] += total[node]
        return total

    def _leave_out(self, named: dict[int, tuple[bool, bool]]) -> None:
        whole = self.blocks
        for spare in (False, True):
            place = list(range(len(self.path)))  # the container that a node's blocks belong to, or -1
            for node in range(1, len(place)):
                above = place[self.parent[node]]
                holder, layout = named.get(node, (True, True))
                if above < 0 or (node in named and not (spare and layout)):
                    place[node] = -1
                elif not holder:
                    place[node] = above
            self.blocks = [(place[node], text, linked) for node, text, linked in whole if place[node] >= 0]
            if any(len(text) > 3 * linked for _, text, linked in self.blocks):
                return

    def best(self) -> tuple[str, int]:
        """The path of the likeliest main container and its score: running text, halved at each step up.

        Where an ancestor of the likeliest holds notably more, within an article or main element if there is one, it is taken instead.
        """
        score = [0] * len(self.path)
        for node, text, linked in self.blocks:
            worth = 256 * max(0, len(text) - 3 * linked)
            while node >= 0 and worth:
                score[node] += worth * self.weight[node]
                node, worth = self.parent[node], worth // 2
        i = max(range(len(score)), key=lambda k: (score[k], -k))
        total, node, most = self._running(), i, score[i]
        while node > 0 and self.weight[i] < 6:
            node = self.parent[node]
            if total[node] - total[i] > MORE * total[i]:
                i = node
            elif self.weight[node] == 6:
                break
        return self.path[i], most

    def text(self, path: str | None) -> str:
        """The blocks within containers of a path, one a line; empty if there are none."""
        inside = [False] * len(self.path)
        for i, own in enumerate(self.path):
            inside[i] = own == path or (self.parent[i] >= 0 and inside[self.parent[i]])
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def nominate(html: Column) -> Column:
    """Struct of path and score of a page's own main container."""

    @F.pandas_udf("path string, score long")
    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Page(x).best() for x in sources], columns=["path", "score"])

    return run(html)


def main_text(html: Column, path: Column) -> Column:
    """The text under a path, or under the page's own main container where the path gives none."""

    @F.pandas_udf("string")
    def run(sources: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for source, path in zip(sources, paths):
            page = Page(source)
            out.append((page.text(path) if path is not None else "") or page.text(page.best()[0]))
        return pd.Series(out, dtype=object)

    return run(html, path)


def extract(pages: DataFrame) -> DataFrame:
    """Every row of (page_id, url, html, ...) with `text` and `n_chars`, and no other column than page_id and url.

    Pages without a host vote together.  NULL and empty pages, and pages without
    running text, give an empty text.  Equal rows give equal results; of paths
    with equally many pages the one of more text wins, then the last by name.
    Every page has one vote, whatever its length; votes are counted per host and
    path before they meet the pages, whose hosts may be skewed.
    """
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    votes = rows.select("host", nominate(F.col("html")).alias("v")).where("v.score > 0").groupBy("host", "v.path").agg(
        F.count("*").alias("pages"), F.sum("v.score").alias("score"))
    winners = small(durable(votes.groupBy("host").agg(F.max(F.struct("pages", "score", "path")).alias("w")).select("host", "w.path")))
    read = join_skewed(rows, winners, "host", "left").select("page_id", "url", main_text(F.col("html"), F.col("path")).alias("text"))
    return read.withColumn("n_chars", F.length("text").cast("long"))
