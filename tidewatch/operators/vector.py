"""Nearest articles by cosine distance.

The corpus never moves when the query batch is small: each task keeps its own
k best per query and only those are shuffled.  A query batch beyond the checked
bound is cut into blocks and met with corpus blocks of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from .dedup import first_per_key
from .topk import top_per_group

# Largest query batch handed to every task: rows, and numbers in all its vectors.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_NUMBERS = 4_000_000
# Rows of a corpus block and of a query block in the large-batch form.
CORPUS_BLOCK = 20_000
QUERY_BLOCK = 2_000
# Queries scored at a time inside a task.
QUERY_SLICE = 256
DISTANCE_DIGITS = 1_000_000


def _unit(vectors) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0, 1.0, norms)


def _nearest(qids: np.ndarray, q: np.ndarray, pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """k nearest rows per query, one per key; distance rounded, ties to the lowest id."""
    pdf = pdf.sort_values("id", kind="stable")
    ids, keys = pdf["id"].to_numpy(), pdf["key"].to_numpy()
    codes = pd.factorize(keys)[0]
    rows = _unit(pdf["embedding"]).T
    parts = []
    for lo in range(0, len(q), QUERY_SLICE):
        distances = np.floor((1.0 - q[lo: lo + QUERY_SLICE] @ rows) * DISTANCE_DIGITS + 0.5) / DISTANCE_DIGITS
        for qid, row in zip(qids[lo: lo + QUERY_SLICE], distances):
            pick = _first_keys(row, codes, k)
            parts.append(pd.DataFrame({"query_id": qid, "id": ids[pick], "key": keys[pick], "distance": row[pick]}))
    return pd.concat(parts, ignore_index=True)


def _first_keys(row: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances with distinct codes; equal distances in row order."""
    m = min(len(row), 4 * k)
    while True:
        # every row up to the m-th smallest distance, so that ties are complete
        near = np.flatnonzero(row <= np.partition(row, m - 1)[m - 1]) if m < len(row) else np.arange(len(row))
        order = near[np.argsort(row[near], kind="stable")]
        _, first = np.unique(codes[order], return_index=True)
        if len(first) >= k or m == len(row):
            return order[np.sort(first)[:k]]
        m = min(len(row), m * 4)


def _best(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """Merge partial results: best row per query and key, then k per query."""
    merged = pd.concat(frames, ignore_index=True).sort_values(["query_id", "distance", "id"], kind="stable")
    merged = merged.drop_duplicates(["query_id", "key"])
    return merged.groupby("query_id", sort=False).head(k)


def _merge(partial: DataFrame, k: int) -> DataFrame:
    one_per_key = first_per_key(partial, F.struct("query_id", "key"), ["distance", "id"])
    ranked = top_per_group(one_per_key, ["query_id"], [F.asc("distance"), F.asc("id")], k, "rank")
    return ranked.select("query_id", "id", "distance", "rank")


def knn(queries: DataFrame, corpus: DataFrame, k: int = vocab.SEARCH_SIZE, list_col: str | None = None,
        probe_col: str = "probes") -> DataFrame:
    """(query_id, id, distance, rank): k nearest corpus rows per query, one per URL.

    queries: query_id, embedding (and with `list_col` an array `probes` of the
    lists to search).  corpus: id, embedding, optional url.  Exact unless
    `list_col` restricts the search.  Queries without a vector find nothing.
    """
    key = F.coalesce(F.col("url"), F.lit("")) if "url" in corpus.columns else F.col("id").cast("string")
    lists = [F.col(list_col).alias("list")] if list_col else []
    body = corpus.filter(F.col("embedding").isNotNull()).select("id", key.alias("key"), "embedding", *lists)
    kind = corpus.schema["id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, id {kind}, key string, distance double"

    asked = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    asked = asked.select("query_id", "embedding", *([F.col(probe_col).alias("probes")] if list_col else []))
    # at most one row more than may be broadcast ever reaches the driver
    batch = asked.limit(MAX_BROADCAST_QUERIES + 1).toPandas()
    if len(batch) > MAX_BROADCAST_QUERIES or sum(len(e) for e in batch["embedding"]) > MAX_BROADCAST_NUMBERS:
        return _knn_blocks(asked, body, k, schema)
    if batch.empty:
        return queries.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, distance double, rank int")
    searched = _Batch(batch)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        for pdf in batches:
            for found in searched.nearest(pdf, k):
                best = [_best(best + [found], k)]
        yield from best

    return _merge(body.mapInPandas(search, schema), k)


class _Batch:
    """Queries (query_id, embedding, optional probes) held by a task."""

    def __init__(self, batch: pd.DataFrame):
        self.ids, self.vectors = batch["query_id"].to_numpy(), _unit(batch["embedding"])
        self.probes = [set(p) for p in batch["probes"]] if "probes" in batch else None

    def nearest(self, pdf: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """The k nearest of some corpus rows; with probes, of the rows of each query's lists."""
        if pdf.empty or not len(self.ids):
            return
        if self.probes is None:
            yield _nearest(self.ids, self.vectors, pdf, k)
            return
        for list_id, members in pdf.groupby("list"):
            asking = np.array([list_id in p for p in self.probes])
            if asking.any():
                yield _nearest(self.ids[asking], self.vectors[asking], members, k)


def _knn_blocks(queries: DataFrame, body: DataFrame, k: int, schema: str) -> DataFrame:
    """The same search for a large query batch: every query block meets every corpus block.

    A task holds one block of each side, so its size does not grow with either
    table; the result is that of a small batch, lists and probes included.
    """
    n_q = math.ceil(queries.count() / QUERY_BLOCK)
    n_c = math.ceil(body.count() / CORPUS_BLOCK)

    def blocks(n: int) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(max(n, 1) - 1).cast("bigint"))

    def own(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(max(n, 1)).cast("bigint"))

    # fresh names on the query side: both sides may stem from one table
    names = {c: f"q_{c}" for c in queries.columns}
    asked = queries.select(*(F.col(c).alias(n) for c, n in names.items())).select(
        *names.values(), own("q_query_id", n_q).alias("qb"), F.explode(blocks(n_c)).alias("cb"))
    held = body.select("*", own("id", n_c).alias("cb"), F.explode(blocks(n_q)).alias("qb"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = list(_Batch(q.rename(columns={n: o for o, n in names.items()})).nearest(c, k)) if len(q) and len(c) else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"query_id": [], "id": [], "key": [], "distance": []})

    met = asked.groupBy("qb", "cb").cogroup(held.groupBy("qb", "cb")).applyInPandas(cell, schema)
    return _merge(met, k)


def coarse_centroids(corpus: DataFrame, lists: int = 100, rounds: int = 5) -> np.ndarray:
    """k-means centres of an inverted-list index; `lists` x dimension numbers on the driver.

    Starts from the rows with the lowest id hashes; every round each task sends
    one sum and count per list.
    """
    vectors = corpus.filter(F.col("embedding").isNotNull())
    seed = vectors.orderBy(F.xxhash64("id"), "id").limit(lists).select("embedding").toPandas()
    centres = _unit(seed["embedding"])
    dim = centres.shape[1]
    for _ in range(rounds):
        held = centres

        def sums(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(held), np.zeros(len(held), dtype=np.int64)
            for pdf in batches:
                if len(pdf):
                    m = _unit(pdf["embedding"])
                    own = np.argmax(m @ held.T, axis=1)
                    np.add.at(total, own, m)
                    np.add.at(count, own, 1)
            used = np.flatnonzero(count)
            if len(used):
                yield pd.DataFrame({"list": used, "n": count[used], "total": [total[i].tolist() for i in used]})

        partial = vectors.select("embedding").mapInPandas(sums, "list int, n bigint, total array<double>")
        folded = partial.groupBy("list").agg(
            *[F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(dim)]
        ).toPandas()
        centres = centres.copy()
        centres[folded["list"].to_numpy()] = folded[[f"d{i}" for i in range(dim)]].to_numpy()
        norms = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
        centres = centres / np.where(norms == 0, 1.0, norms)
    return centres


def assign_lists(df: DataFrame, centres: np.ndarray, probes: int = 1, name: str = "list") -> DataFrame:
    """Nearest list of each row, or an array of the `probes` nearest lists."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        near = np.argsort(-(_unit(vectors) @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(near.astype(np.int32)))

    lists = nearest("embedding")
    return df.withColumn(name, F.get(lists, F.lit(0)) if probes == 1 and name == "list" else lists)


def knn_bucketed(queries: DataFrame, corpus: DataFrame, k: int = vocab.SEARCH_SIZE, lists: int = 100,
                 probes: int = 10) -> DataFrame:
    """Approximate search of the `probes` nearest of `lists` inverted lists.

    Store `assign_lists(corpus, ...)` partitioned by list to skip the lists no
    query asks for.
    """
    centres = coarse_centroids(corpus, lists)
    indexed = assign_lists(corpus, centres)
    asked = assign_lists(queries, centres, probes, "probes")
    return knn(asked, indexed, k, list_col="list")


def write_index(corpus: DataFrame, path: str, lists: int = 100) -> None:
    """Keep an inverted-list index of (id, embedding, ...): its centres, and the rows laid out by list.

    Rows without a vector are left out.  The centres are trained here and only
    here; append_index adds rows to the same lists.
    """
    spark = corpus.sparkSession
    centres = coarse_centroids(corpus, lists)
    kept = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    append_index(corpus, path, 0)


def index_centres(spark: SparkSession, path: str) -> np.ndarray:
    """The centres of a kept index, `lists` x dimension numbers."""
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])


def append_index(rows: DataFrame, path: str, batch: int) -> None:
    """Add a batch of rows to a kept index; writing a batch again replaces it.

    Only the new rows are assigned to lists.  Rebalancing splits a crowded list
    over several files.
    """
    placed = assign_lists(rows.filter(F.col("embedding").isNotNull()), index_centres(rows.sparkSession, path))
    (
        placed.withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", "list")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list", "batch").parquet(f"{path}/rows")
    )


def knn_index(queries: DataFrame, path: str, k: int = vocab.SEARCH_SIZE, probes: int = 10) -> DataFrame:
    """knn() over a kept index, of each query's `probes` nearest lists.

    No pass over the rows comes before the search, and of the rows only the
    folders of lists that some query asks for are read.
    """
    centres = index_centres(queries.sparkSession, path)
    asked = assign_lists(queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)), centres, probes, "probes")
    wanted = [r[0] for r in asked.select(F.explode("probes")).distinct().collect()]  # at most as many as there are lists
    rows = queries.sparkSession.read.parquet(f"{path}/rows")
    return knn(asked, rows.filter(F.col("list").isin(wanted)), k, list_col="list")
