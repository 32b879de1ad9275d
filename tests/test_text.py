import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text


@pytest.mark.parametrize("title,key", [
    ("Big News - Reuters", "big news"), ("big news - AP", "big news"), ("No outlet", "no outlet"), (" - Reuters", ""), (None, ""),
])
def test_title_key(val, title, key):
    assert val(text.title_key("x"), x=title) == key


def test_fingerprint_keeps_a_bare_outlet(val):
    assert val(text.fingerprint_title("x"), x=" - Reuters") == " - Reuters"


@pytest.mark.parametrize("body,expected", [
    ("", {""}), ("One", {"one"}), ("one two", {"one two"}), ("one two three", {"one two three"}),
    ("a b c d", {"a b c", "b c d"}), ("Éa ß_1 x\ny", {"éa ß_1 x", "ß_1 x y"}), ("x y z x y z", {"x y z", "y z x", "z x y"}),
])
def test_shingles(val, body, expected):
    got = val(text.shingles("x"), x=body)
    assert set(got) == expected and len(got) == len(expected)


def test_symbol_tokens(val):
    body = "AAPL beats, $TSLA falls; THE CEO of AAPL and a$GM says ABCDEF GOOGL. ÉAB xMSFT IBM_1"
    assert val(text.symbol_tokens("x"), x=body) == ["AAPL", "TSLA", "GM", "GOOGL"]


def test_company_keywords(val):
    assert val(text.company_keywords("x"), x="Goldman Sachs Group, Inc.") == ["goldman", "sachs"]
    assert val(text.company_keywords("x"), x="The Bank of America Corp.") == ["america"]
    assert val(text.company_keywords("x"), x="3M") == []


def test_quotations(val):
    raw = '1,2,Ann,"first, with comma"|broken|3,4,Bob,|5,6,Cy, second |7,8,Di,third|9,9,Ed,fourth'
    assert val(text.quotation_text("x"), x=raw) == '"first, with comma" second third'
    assert val(text.quotation_text("x"), x="") is None


def test_page_title(val):
    assert val(text.page_title("x"), x="<A/><PAGE_TITLE> Two\nlines </PAGE_TITLE>") == "Two\nlines"
    assert val(text.page_title("x"), x="<PAGE_TITLE>  </PAGE_TITLE>") is None
    assert val(text.page_title("x"), x="none") is None


@pytest.mark.parametrize("v2,v1,hit", [
    ("TAX_A,1;ECON_IPO_X,2", "", True), ("XECON_IPO,2", "", False), ("", "BUS_MERGER", True), ("WB_1,BUS_IPO", None, False),
])
def test_themes(val, v2, v1, hit):
    assert val(text.theme_match("a", "b"), "a string, b string", a=v2, b=v1) is hit


def test_compose(val):
    assert val(text.compose_text("a", "b", sep="\n\n"), "a string, b string", a=None, b="body") == "\n\nbody"
    assert val(text.compose_text("a", "b", 4), "a string, b string", a="abc", b="def") == "abc "


def test_split_keywords(val):
    assert val(text.split_keywords("x"), x=" AI chip-maker a News? ") == ["maker", "news"]


def test_stable_id(val):
    import hashlib

    expected = "googlenews-" + hashlib.md5(b"q||u").hexdigest()[:12]
    assert val(text.stable_id("googlenews", "a", "b"), "a string, b string", a="q", b="u") == expected


def test_strip_equals_the_unicode_class(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = [(chr(c) + "a" + chr(c) + "b" + chr(c) * 2,) for c in codes] + [(None,), ("",), (" \n\t ",), ("a\n",)]
    df = spark.createDataFrame(rows, "s string")
    assert df.filter(~text.strip("s").eqNullSafe(F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).isEmpty()
