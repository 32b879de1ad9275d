"""Text functions.  `(?U)` makes Java classes Unicode-aware, as the data needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_WORD = r"([\p{L}\p{N}_]+)"
_AFTER_WORD = r"(?![\p{L}\p{N}_])"
_BEFORE_WORD = r"(?<![\p{L}\p{N}_])"
#: Every character of the class (?U)\s.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once; lambdas defeat subexpression reuse."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(_col(text), F.lit(_SPACES))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))


def strip_outlet(title: Column | str) -> Column:
    """Drop a trailing " - Publisher"."""
    return strip(F.regexp_replace(_col(title), "(?U)" + vocab.OUTLET_SUFFIX, ""))


def title_key(title: Column | str) -> Column:
    """Outlet-stripped lower-case title; empty for a missing title."""
    return F.coalesce(F.lower(strip_outlet(title)), F.lit(""))


def fingerprint_title(title: Column | str) -> Column:
    """Outlet-stripped title, or the title itself when nothing is left."""
    return F.coalesce(blank_to_null(strip_outlet(title)), _col(title))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """`prefix-` plus twelve hex digits of the MD5 of the parts joined by ||."""
    joined = F.concat_ws("||", *[_col(p) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(joined), 1, 12))


def page_title(extras: Column | str) -> Column:
    """Text of the PAGE_TITLE element, NULL when absent or blank."""
    return blank_to_null(strip(F.regexp_extract(_col(extras), vocab.PAGE_TITLE, 1)))


def quotation_text(quotations: Column | str, n: int = 3) -> Column:
    """First n quoted passages of `offset,count,speaker,quote|...`; NULL if none."""
    fields = F.transform(F.split(strip(quotations), r"\|"), lambda e: F.split(e, ",", 4))
    quoted = F.filter(fields, lambda f: (F.size(f) == 4) & (F.get(f, F.lit(3)) != ""))
    texts = F.transform(F.slice(quoted, 1, n), lambda f: strip(F.get(f, F.lit(3))))
    return let(texts, lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")))


def theme_match(themes_v2: Column | str, themes_v1: Column | str | None = None,
                prefixes: tuple[str, ...] = vocab.FINANCE_THEMES) -> Column:
    """Any theme token (the part before a comma) starts with one of the prefixes."""
    pattern = "(^|;)(" + "|".join(prefixes) + ")"
    found = F.coalesce(_col(themes_v2).rlike(pattern), F.lit(False))
    if themes_v1 is not None:
        found = found | F.coalesce(_col(themes_v1).rlike(pattern), F.lit(False))
    return found


def words(text: Column | str) -> Column:
    """Lower-case word tokens of any script."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(_WORD), 1)


def shingle_strings(tokens: Column, k: int = vocab.SHINGLE_WORDS) -> Column:
    """Distinct k-word shingles of a token array; short texts give one shingle.

    Shifted copies of the array are zipped, so the work is linear in the text.
    """
    n = F.greatest(F.size(tokens), F.lit(1))
    grams = tokens
    for shift in range(1, k):
        # zip_with pads with NULL, concat keeps NULL: incomplete shingles vanish
        grams = F.zip_with(grams, F.slice(tokens, F.lit(shift + 1), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) < k, F.array(F.array_join(tokens, " "))).otherwise(
        F.array_distinct(F.array_compact(grams))
    )


def shingles(text: Column | str, k: int = vocab.SHINGLE_WORDS) -> Column:
    """Set of word k-shingles of a text."""
    return let(words(text), lambda tokens: shingle_strings(tokens, k))


def symbol_tokens(text: Column | str) -> Column:
    """Ticker-like tokens in first-seen order, stop words removed."""
    bare = _BEFORE_WORD + "[A-Z]{2,5}" + _AFTER_WORD
    cash = r"\$[A-Z]{2,5}" + _AFTER_WORD
    found = F.regexp_extract_all(_col(text), F.lit(f"({cash}|{bare})"), 1)
    symbols = F.transform(found, lambda t: F.ltrim(t, F.lit("$")))
    return F.array_except(symbols, F.array(*[F.lit(w) for w in vocab.ARTICLE_STOPWORDS]))


def company_keywords(name: Column | str) -> Column:
    """Identifying words of a company name, longest first."""
    legal = r"(?i)\b(" + "|".join(vocab.LEGAL_SUFFIXES) + r")\b\.?"
    cleaned = F.regexp_replace(F.regexp_replace(_col(name), legal, " "), "[^A-Za-z0-9 ]", " ")
    long_words = F.filter(F.split(F.lower(cleaned), " +"), lambda w: F.length(w) >= vocab.MIN_KEYWORD_CHARS)
    kept = F.array_except(long_words, F.array(*[F.lit(w) for w in vocab.KEYWORD_BLOCKLIST]))
    return F.array_sort(
        kept,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1).when(a > b, 1).otherwise(0),
    )


def compose_text(title: Column | str, content: Column | str, max_chars: int | None = None,
                 sep: str = " ") -> Column:
    """Title and content as one text, optionally cut for a model."""
    text = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(sep), F.coalesce(_col(content), F.lit("")))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def split_keywords(query: Column | str) -> Column:
    """Words of a query longer than one character that name no sector."""
    parts = F.split(F.lower(strip(query)), r"(?U)\W+")
    return F.filter(
        parts, lambda w: (F.length(w) > 1) & ~w.isin([k for k in vocab.SECTOR_KEYWORDS if " " not in k])
    )
