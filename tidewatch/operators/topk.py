"""Top-k, ranks, caps and title de-duplication.

`row_number() <= k` per group is planned as a group limit, so each input
partition forwards at most k rows of a group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from .dedup import first_per_key


def top_global(ranked: DataFrame, n: int = vocab.BOARD_SIZE, by: str = "score") -> DataFrame:
    """The n best rows."""
    return ranked.orderBy(F.desc(by), "symbol").limit(n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank_name: str | None = None) -> DataFrame:
    """The first n rows of every group, optionally with their rank."""
    rank = rank_name or "_rank"
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return out if rank_name else out.drop(rank)


def top_per_sector(ranked: DataFrame, n: int = vocab.BOARD_SIZE) -> DataFrame:
    """The n best tickers of every sector; a missing sector is 'Unknown'."""
    named = ranked.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return top_per_group(named, ["sector"], [F.desc("score"), F.asc("symbol")], n)


def with_rank(board: DataFrame, group: list[str], by: str = "score") -> DataFrame:
    """Rank 1..n on each board."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), F.asc("symbol"))
    return board.withColumn("rank", F.row_number().over(w))


def relative_score(board: DataFrame, group: list[str]) -> DataFrame:
    """Score as a percentage of the board's best score, at most 100."""
    best = F.greatest(F.max("score").over(Window.partitionBy(*group)), F.lit(1.0))
    return board.withColumn("relative", F.least(F.lit(100.0), F.col("score") / best * F.lit(100.0)))


def latest_per_url(news: DataFrame, k: int | None = vocab.SEARCH_SIZE, group: list[str] | None = None) -> DataFrame:
    """One row per URL (highest id), newest first; NULL URLs share one row.

    With `group`, both the URL rule and the cut apply within each group.
    """
    group = group or []
    key = F.struct(*group, "url") if group else F.struct("url")
    unique = first_per_key(news, key, ["id", "timestamp", F.col("sentiment")] if "sentiment" in news.columns
                           else ["id", "timestamp"], latest=True)
    if k is None:
        return unique
    order = [F.desc("timestamp"), F.desc("id")]
    return top_per_group(unique, group, order, k) if group else unique.orderBy(*order).limit(k)


def _title_rule(news: DataFrame, key: Column, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group, "_key").orderBy(F.desc("timestamp"), F.asc("id"))
    return news.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def dedupe_titles(news: DataFrame, group: list[str]) -> DataFrame:
    """Newest row per outlet-stripped title; untitled rows are never merged."""
    key = F.coalesce(text.blank_to_null(text.title_key("title")), F.col("id").cast("string"))
    return _title_rule(news, key, group)


def dedupe_exact_titles(news: DataFrame, group: list[str]) -> DataFrame:
    """Newest row per lower-case title; NULL titles are never merged."""
    key = F.coalesce(F.lower(text.strip("title")), F.col("id").cast("string"))
    return _title_rule(news, key, group)


def cap_per_key(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """At most n rows per feed, symbol or run, in feed order."""
    return top_per_group(df, keys, order, n)


def lead_sentiment(items: DataFrame, column: str = "confirmed") -> DataFrame:
    """Representative sentiment of an item: that of its first confirmed ticker."""
    first = F.get(F.col(column), F.lit(0))
    return items.withColumn("sentiment", first["sentiment"])
