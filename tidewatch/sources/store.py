"""The article store (parquet, partitioned by publication date) and the board sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema


def load_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Ticker dimension from CSV (header) or parquet, in symbol order."""
    reader = spark.read.schema(schema.TICKERS)
    table = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)
    return schema.conform(table, schema.TICKERS).orderBy("symbol")


def _with_batch(spec: T.StructType) -> T.StructType:
    return T.StructType([*spec.fields, T.StructField("batch", T.LongType())])


def file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path, and the path as that system's object."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def load_table(spark: SparkSession, path: str, spec: T.StructType) -> DataFrame:
    """A table of the store; empty before the first write."""
    fs, jpath = file_system(spark, path)
    if not fs.exists(jpath):
        return spark.createDataFrame([], spec)
    return spark.read.schema(spec).parquet(path)


def load_articles(spark: SparkSession, store: str) -> DataFrame:
    return load_table(spark, f"{store}/articles", _with_batch(schema.ARTICLES))


def load_mentions(spark: SparkSession, store: str) -> DataFrame:
    return load_table(spark, f"{store}/mentions", _with_batch(schema.MENTIONS))


def feed_tables(items: DataFrame, tickers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, mentions) of confirmed items.

    Ids derive from the URL, so storing an item twice gives the same rows.
    Mentions carry the publication date of their article; with `tickers`,
    mentions of unknown symbols are left out.
    """
    keyed = items.withColumn("item_id", F.col("id")).withColumn(
        "id", F.xxhash64(F.coalesce("url", "id"))
    ).withColumn("dt", F.to_date("timestamp"))
    articles = schema.conform(keyed, schema.ARTICLES)
    spread = keyed.select(
        F.col("id").alias("article_id"), "dt", "created_at", F.posexplode("confirmed").alias("pos", "m")
    )
    mentions = spread.select(
        F.xxhash64("article_id", "m.ticker", "pos").alias("id"), F.col("m.ticker").alias("ticker"), "article_id",
        F.col("m.sentiment").alias("sentiment"), F.col("m.source_weight").alias("source_weight"),
        F.col("m.summary").alias("llm_summary"), "created_at", "dt",
    )
    if tickers is not None:
        mentions = mentions.join(tickers.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
    return articles, schema.conform(mentions, schema.MENTIONS)


def write_table(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch; writing it again replaces it.

    Rebalancing splits a crowded date over several files and merges small ones.
    """
    (
        df.withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", "dt")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "batch").parquet(path)
    )


def write_feed(items: DataFrame, store: str, batch: int = 0, tickers: DataFrame | None = None, keywords: bool = False) -> None:
    """Store items, their mentions and the filters of their URLs, on request also their keyword postings.

    The filters of a batch go before its articles are replaced and come back
    after them: a date without its filter is read, so an interrupted run loses
    nothing.
    """
    from . import postings, url_filter

    articles, mentions = feed_tables(items, tickers)
    url_filter.forget(items.sparkSession, store, batch)
    write_table(articles, f"{store}/articles", batch)
    write_table(mentions, f"{store}/mentions", batch)
    url_filter.write(articles, store, batch)
    if keywords:
        postings.write(articles, store, batch)


def drop_partitions(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> None:
    """Delete the folders `column=value` of a table whose value is gone."""
    fs, root = file_system(spark, path)
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        name = entry.getPath().getName()
        value = name.removeprefix(f"{column}=")
        if value != name and not value.startswith("__") and gone(value):
            fs.delete(entry.getPath(), True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a versioned folder, oldest first."""
    fs, root = file_system(spark, path)
    names = [e.getPath().getName() for e in fs.listStatus(root)] if fs.exists(root) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    jvm = spark.sparkContext._jvm
    return [v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS"))]


def write_leaderboard(boards: DataFrame, path: str) -> None:
    """Replace all boards; one partition per board (a board is at most ten rows).

    A new version is written beside the current one and counts once it is
    complete, so a reader always finds whole boards.  The version before it
    stays for readers that have begun; older ones go.
    """
    spark = boards.sparkSession
    before = _versions(spark, path)
    number = before[-1] + 1 if before else 0
    boards.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("board").parquet(f"{path}/version={number}")
    fs, _ = file_system(spark, path)
    for old in before[:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


def load_boards(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of all boards."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def list_boards(boards: DataFrame) -> DataFrame:
    """Names of the stored boards, the global one included."""
    return boards.select("board").distinct().orderBy("board")


def read_board(spark: SparkSession, path: str, board: str) -> DataFrame:
    """One board, best first; reads only its partition."""
    return load_boards(spark, path).filter(F.col("board") == board).orderBy("rank")
