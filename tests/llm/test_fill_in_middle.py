"""Outputs, digests and restored texts against the definition."""

import hashlib
import re

import numpy as np

from tidewatch.llm import fill_in_middle as fim

SHAPE = "doc_id long, text string, row long, place long, form string"


def by_definition(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h[3] % 100 < 20 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return (doc_id, n, form, len(prefix), len(middle), out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents():
    rng = np.random.default_rng(4)
    letters = list("abcXYZ  \n.,1é日😀<>PSM") + ["word", " the "]
    texts = [None, "", "a", " ", "<P>", "x<M>y", "<", "<S", "😀", "é" * 5]
    texts += ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(150)]
    rows = [(i, t, 1, 2, "f") for i, t in enumerate(texts)]
    return rows + [(None, "no id here", None, None, None), (7, "twice", 1, 1, ""), (7, "twice", 1, 1, ""), (900, "long text, " * 30_000, 0, 0, "")]


def test_against_the_definition(spark, monkeypatch):
    rows = documents()
    want = sorted((by_definition(r[0], r[1]) for r in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = sorted(((*w[:5], sha(w[5]), sha(r[1] or "")) for r in rows for w in [by_definition(r[0], r[1])]), key=str)
    for units in (fim.UNITS, 3):
        monkeypatch.setattr(fim, "UNITS", units)
        docs = spark.createDataFrame(rows if units > 3 else rows[:-1], SHAPE).repartition(3)
        got = fim.transform(docs)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == [d for d in digests if units > 3 or d[0] != 900]


def test_texts(spark):
    rows = documents()
    got = fim.texts(fim.pieces(spark.createDataFrame(rows, SHAPE))).collect()
    show = lambda doc_id: None if doc_id is None else str(doc_id)
    assert sorted(map(tuple, got), key=str) == sorted(((show(w[0]), w[2], w[5]) for w in (by_definition(r[0], r[1]) for r in rows)), key=str)


def test_one_shuffle(spark, capfd):
    fim.transform(spark.createDataFrame(documents(), SHAPE)).explain()
    plan = capfd.readouterr().out
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 3


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SHAPE)).count() == 0
