"""Upserts, backfills and retention as set-based rewrites."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash, scores, text, times, vocab
from ..session import durable
from ..sources import store
from .dedup import first_per_key
from .models import embed


def upsert_tickers(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Dimension plus the new symbols; an existing key wins, the first new one otherwise."""
    cols = ["symbol", "sector", "company_name"]
    fresh = first_per_key(new.select(*cols), "symbol", ["sector", "company_name"])
    return existing.select(*cols).unionByName(fresh.join(existing.select("symbol"), "symbol", "left_anti").select(*cols))


def backfill_minhash(articles: DataFrame) -> DataFrame:
    """Articles with every missing signature computed from the content."""
    missing = F.col("minhash_signature").isNull()
    fresh = minhash.signature(F.when(missing, F.col("content")))
    return articles.withColumn("minhash_signature", F.when(missing, fresh).otherwise(F.col("minhash_signature")))


def backfill_embeddings(articles: DataFrame, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Articles with every missing embedding encoded from title and content."""
    done = articles.filter(F.col("embedding").isNotNull())
    todo = articles.filter(F.col("embedding").isNull()).drop("embedding")
    body = text.strip(text.compose_text("title", "content"))
    filled = embed(todo.withColumn("_text", body), encoder, "_text").drop("_text")
    return done.unionByName(filled.select(*articles.columns))


def _owned(mentions: DataFrame, articles: DataFrame, *cols) -> tuple[DataFrame, list[str]]:
    """The articles' side of a join with their mentions, and its keys: the date too where both carry it, so dates prune."""
    keys = ["article_id", *(["dt"] if "dt" in mentions.columns and "dt" in articles.columns else [])]
    return articles.withColumn("article_id", F.col("id")).select(*keys, *cols), keys


def weight_audit(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Dry run of the weight backfill: default-weight mentions per source and their new weight."""
    pending = mentions.filter(scores.weight_units("source_weight") == scores.WEIGHT_UNIT)
    sources, keys = _owned(mentions, articles, "source")
    counts = pending.join(sources, keys).groupBy("source").agg(F.count("*").alias("mention_count"))
    return counts.withColumn("new_weight", scores.source_weight("source")).orderBy(F.desc("mention_count"), "source")


def backfill_weights(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions with the weight of their source wherever it is still the default 1.0; only those are joined."""
    pending = F.coalesce(scores.weight_units("source_weight") == scores.WEIGHT_UNIT, F.lit(False))
    sources, keys = _owned(mentions, articles, F.col("source").alias("_source"))
    joined = mentions.filter(pending).join(sources, keys, "left")
    weight = F.when(F.col("_source").isNotNull(), scores.source_weight("_source")).otherwise(F.col("source_weight"))
    return mentions.filter(~pending).unionByName(joined.withColumn("source_weight", weight).select(*mentions.columns))


def rewrite_dates(spark: SparkSession, store_path: str, table: str, pending: Column, fix: Callable[[DataFrame], DataFrame]) -> list[dt.date]:
    """Apply `fix` to the dates of a stored table that hold a `pending` row, and rewrite those dates only.

    The fixed rows are kept on shared storage before their partitions are
    replaced, so an interrupted run can be repeated.  Returns the dates.
    """
    rows = (store.load_articles if table == "articles" else store.load_mentions)(spark, store_path)
    dates = sorted(r["dt"] for r in rows.filter(pending).select("dt").distinct().collect())
    if dates:
        fixed = durable(fix(rows.filter(F.col("dt").isin(dates))))
        (
            fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch").parquet(f"{store_path}/{table}")
        )
    return dates


def rewrite_minhash(spark: SparkSession, store_path: str) -> list[dt.date]:
    """Store the missing signatures."""
    return rewrite_dates(spark, store_path, "articles", F.col("minhash_signature").isNull(), backfill_minhash)


def rewrite_embeddings(spark: SparkSession, store_path: str, encoder: Callable[[list[str]], np.ndarray]) -> list[dt.date]:
    """Store the missing embeddings."""
    return rewrite_dates(spark, store_path, "articles", F.col("embedding").isNull(), lambda rows: backfill_embeddings(rows, encoder))


def rewrite_weights(spark: SparkSession, store_path: str) -> list[dt.date]:
    """Store the weights that are still the default but should not be; a second run finds none."""
    articles = store.load_articles(spark, store_path)
    telling = [s for s, w in vocab.SOURCE_WEIGHTS.items() if w != vocab.DEFAULT_WEIGHT]
    owners, keys = _owned(store.load_mentions(spark, store_path), articles.filter(F.col("source").isin(*telling)))
    default = scores.weight_units("source_weight") == scores.WEIGHT_UNIT
    mentions = store.load_mentions(spark, store_path)
    dates = sorted(r["dt"] for r in mentions.filter(default).join(owners, keys, "left_semi").select("dt").distinct().collect())
    if not dates:
        return []
    return rewrite_dates(spark, store_path, "mentions", default & F.col("dt").isin(dates), lambda rows: backfill_weights(
        rows, articles.filter(F.col("dt").isin(dates))))


def retain(articles: DataFrame, mentions: DataFrame, as_of: dt.datetime,
           days: int = vocab.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Articles of the retention period and the mentions that belong to them; with dates, no older date is read."""
    edge = as_of - dt.timedelta(days=days)
    kept = articles.filter(F.col("timestamp") >= times.literal_like(articles, "timestamp", edge))
    if "dt" in articles.columns:
        kept = kept.filter(F.col("dt") >= F.lit(times.utc(edge).date()))
    owners, keys = _owned(mentions, kept)
    dated = mentions.filter(F.col("dt") >= F.lit(times.utc(edge).date())) if "dt" in keys else mentions
    return kept, dated.join(owners, keys, "left_semi").select(*mentions.columns)


def expire_store(spark: SparkSession, store_path: str, as_of: dt.datetime, days: int = vocab.RETENTION_DAYS) -> None:
    """Apply retention to a stored feed.

    Whole dates are removed as partitions, without reading them; only the date
    that holds the cutoff is rewritten, and nothing is removed before its
    surviving rows are in place, so an interrupted run can simply be repeated.
    """
    edge = (times.utc(as_of) - dt.timedelta(days=days)).date()
    articles = store.load_articles(spark, store_path).filter(F.col("dt") == F.lit(edge))
    mentions = store.load_mentions(spark, store_path).filter(F.col("dt") == F.lit(edge))
    kept, owned = retain(articles, mentions, as_of, days)
    edge_rows = {"articles": durable(kept), "mentions": durable(owned)}
    for table, rows in edge_rows.items():
        path = f"{store_path}/{table}"
        fs, root = store.file_system(spark, path)
        if not fs.exists(root):
            continue
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch").parquet(path)
        )
        alive = {f"batch={r['batch']}" for r in rows.select("batch").distinct().collect()}
        for entry in fs.listStatus(root):
            day = entry.getPath().getName().removeprefix("dt=")
            if day == edge.isoformat():
                for part in fs.listStatus(entry.getPath()):
                    if part.getPath().getName() not in alive:
                        fs.delete(part.getPath(), True)
            elif entry.getPath().getName().startswith("dt=") and day < edge.isoformat():
                fs.delete(entry.getPath(), True)
    # what is kept beside the articles goes by whole dates; rows of the cutoff's date that are gone meet no article
    for table in ("url_filters", "postings", "vocabulary"):
        store.drop_partitions(spark, f"{store_path}/{table}", "dt", lambda day: day < edge.isoformat())
