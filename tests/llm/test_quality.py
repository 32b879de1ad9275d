"""Counts and verdicts against plain Python."""

import random
import re

from tidewatch.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(quality.SYMBOLS, text))
    dups = len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    bad = (
        10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * dups > len(text.split("\n"))
        or 10 * sum(any(c.isalpha() for c in w) for w in words) < 6 * n or 2 * sum(w.endswith("!!") for w in words) > n
        or 10 * sum(c in quality.CAPITALS for c in text) > 7 * chars or 3 * sum(a == b for a, b in zip(words, words[1:])) > n
    )
    return n, chars, symbols, dups, len(covered), failed, not failed and not bad


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "one two three four five", "a b c d e a b c d e", "w " * 12, "A!! " * 12 + "x y", "x\ny\nx\ny\n\nx",
           "the cat | sat | on | the | mat | and | was | here", "### $$$ %%% a b c d e f g h", "12 34 56 78 90 11 12 13 14 15 16 a",
           " ".join(f"word{i}" for i in range(20_000)), "ALL CAPITALS HERE ÄÖÜ AND MORE OF THEM NOW YES INDEED SO",
           "ab cd ef\x0bgh\x0cij\rkl mn op qr st uv wx yz", "é😀 ñ " * 3 + "plain words that follow here and end"]
    for _ in range(120):
        words = [rng.choice(["a", "bb", "ccc", "d!!", "#", "Ee", "f\n", "|"]) for _ in range(rng.randint(1, 60))]
        out.append(" ".join(words))
    return out


def test_judge(spark):
    rows = [(i if i else None, t, "x", 1, True) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string, words string, n_words int, kept boolean")
    got = quality.judge(df).collect()
    assert len(got) == len(rows) + 2
    want = {r[0]: plain(r[1]) for r in rows}
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], (r, rows[r.doc_id or 0][1][:80])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_order_prefers_cheap_rejections(monkeypatch):
    found = {"few": (2, 2.0), "dear": (10, 9.0), "many": (50, 2.0)}
    monkeypatch.setattr(quality, "measured", lambda sample, rule: found[rule] if rule else (0, 1.0))
    assert quality.order(None, {name: name for name in found}) == ["many", "few", "dear"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
