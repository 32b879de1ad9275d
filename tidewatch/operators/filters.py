"""Windows, predicates and record guards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text, times, vocab


def window_hours(window: str) -> int:
    """Hours of a named look-back window."""
    if window not in vocab.WINDOW_HOURS:
        raise ValueError(f"invalid window {window!r}; use one of {list(vocab.WINDOW_HOURS)}")
    return vocab.WINDOW_HOURS[window]


def after(df: DataFrame, as_of: dt.datetime, delta: dt.timedelta, column: str = "timestamp") -> Column:
    """One-sided look-back predicate: rows newer than `as_of` count too."""
    return F.col(column) >= times.literal_like(df, column, as_of - delta)


def since(df: DataFrame, as_of: dt.datetime, hours: float, column: str = "timestamp") -> DataFrame:
    """Rows of the last `hours`; prunes `dt` partitions when the table has them."""
    delta = dt.timedelta(hours=hours)
    out = df.filter(after(df, as_of, delta, column))
    if "dt" in df.columns and column == "timestamp":
        out = out.filter(F.col("dt") >= F.lit((times.utc(as_of) - delta).date()))
    return out


def in_window(df: DataFrame, window: str, as_of: dt.datetime) -> DataFrame:
    """Rows of a named look-back window."""
    return since(df, as_of, window_hours(window))


def counted(sources: tuple[str, ...] = vocab.UNCOUNTED_SOURCES) -> Column:
    """True for sources that count as mentions."""
    return ~F.col("source").isin(*sources)


def exclude_sources(df: DataFrame, sources: tuple[str, ...] = vocab.UNCOUNTED_SOURCES) -> DataFrame:
    return df.filter(counted(sources))


def filter_sector(tickers: DataFrame, sector: str | None) -> DataFrame:
    """Tickers of a sector or sector alias; all of them without one."""
    if not sector:
        return tickers
    return tickers.filter(F.col("sector") == vocab.SECTOR_KEYWORDS.get(sector.lower(), sector))


def filter_symbols(df: DataFrame, symbols: DataFrame | list[str], column: str = "ticker") -> DataFrame:
    """Rows of the given symbols (a short list, or a DataFrame with `symbol`)."""
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(F.col("symbol").alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(symbols))


def filter_themes(df: DataFrame, v2: str = "themes_v2", v1: str = "themes_v1",
                  prefixes: tuple[str, ...] = vocab.FINANCE_THEMES) -> DataFrame:
    return df.filter(text.theme_match(v2, v1, prefixes))


def known_tickers(items: DataFrame, tickers: DataFrame, column: str = "tickers") -> DataFrame:
    """Restrict each item's ticker array to known symbols, order and repeats preserved.

    The result depends on the array alone, so each distinct array is resolved
    once and joined back by value.
    """
    arrays = items.select(F.col(column).alias("_named")).filter(F.size("_named") > 0).distinct()
    spread = arrays.select("_named", F.posexplode("_named").alias("_pos", "symbol"))
    known = (
        spread.join(tickers.select("symbol").distinct(), "symbol", "left_semi")
        .groupBy("_named").agg(F.array_sort(F.collect_list(F.struct("_pos", "symbol"))).alias("_hits"))
        .select("_named", F.transform("_hits", lambda k: k["symbol"]).alias("_known"))
    )
    joined = items.join(known, F.col(column) == F.col("_named"), "left")
    kept = F.coalesce("_known", F.array().cast("array<string>"))
    return joined.withColumn(column, kept).select(*items.columns)


def valid_items(items: DataFrame, need_http: bool = False, need_tickers: bool = False) -> DataFrame:
    """Normalised items fit to store: a URL, some content and, if asked, a ticker."""
    ok = F.col("url").isNotNull() & (F.col("url") != "") & F.col("content").isNotNull()
    if need_http:
        ok = ok & F.col("url").startswith("http")
    if need_tickers:
        ok = ok & (F.size("tickers") > 0)
    return items.filter(ok)


def confirmed_mentions(scored: DataFrame) -> DataFrame:
    """(article, ticker) pairs the scorer calls relevant, sentiment cleaned."""
    return scored.filter(F.coalesce(F.col("is_relevant"), F.lit(False)) & F.col("sentiment").isNotNull()).withColumn(
        "sentiment", scores.clamp_sentiment("sentiment")
    )
