"""Approximate nearest neighbours over sharded, robust-pruned graphs.

Vectors are dealt to shards by a digest.  Each shard grows a directed graph:
greedy searches from its medoid propose neighbours for a point, and relaxed
pruning keeps an edge unless a kept neighbour is already closer to its end by a
factor, so edges point in diverse directions.  A query runs a beam search in
every shard, and the shards' answers are merged with exact distances.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable

#: Vectors per shard, queries that search a shard in one task, points that enter a graph at a time.
SHARD_ROWS, QUERY_BLOCK, BATCH = 8192, 20_000, 512
#: Edges a pruned point keeps, edges it may gather before it is pruned again, and the relaxation of distances.
DEGREE, WIDTH, ALPHA = 24, 48, 1.2
#: Beam widths while building and searching, and beam entries expanded at a time.
BUILD_BEAM, SEARCH_BEAM, EXPAND = 64, 128, 4


#: How far from a shard's vectors, in their own spread, a query may lie; farther ones are moved there along their direction.
FAR = 1e4


class Frame:
    """The space in which a shard is searched: vectors are centred and scaled in double precision first.

    Offsets and units of the vectors then neither drown their differences in
    single precision nor leave its range.  Medians, as a vector of another order
    of magnitude must not decide.
    """

    def __init__(self, vectors: np.ndarray):
        self.unit = float(np.median(np.abs(vectors).max(axis=1)))
        scaled = self._scaled(vectors)
        self.centre = np.median(scaled, axis=0)
        apart = np.abs(scaled - self.centre).max(axis=1)
        self.spread = float(np.median(apart)) or float(apart.max()) or 1.0

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(vectors / self.unit, -1e100, 1e100)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out = (self._scaled(vectors) - self.centre) / self.spread
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out * np.minimum(1, FAR / np.maximum(length, 1))).astype(np.float32)


def _distances(points: np.ndarray, targets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each target to its own row of point ids."""
    gap = points[ids]
    gap -= targets[:, None]
    return np.einsum("nmd,nmd->nm", gap, gap)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target the `beam` nearest points met, nearest first, and their squared distances; -1 pads."""
    n = len(targets)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = _distances(points, targets, np.full((n, 1), start))[:, 0]
    active = np.arange(n)
    while len(active):
        rows = np.arange(len(active))[:, None]
        own, far, old = ids[active], dist[active], done[active]
        pick = np.argsort(old, axis=1, kind="stable")[:, :EXPAND]
        fresh = ~old[rows, pick]
        old[rows, pick] = True
        found = np.where(fresh[..., None], edges[own[rows, pick]], -1).reshape(len(active), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        known = np.sort(own, axis=1)
        at = np.empty(found.shape, np.int64)
        for i in range(len(found)):
            at[i] = np.searchsorted(known[i], found[i])
        found[known[rows, np.minimum(at, beam - 1)] == found] = -1
        gap = np.where(found >= 0, _distances(points, targets[active], np.maximum(found, 0)), np.inf)
        all_ids, all_far = np.concatenate([own, found], axis=1), np.concatenate([far, gap], axis=1)
        all_old = np.concatenate([old, found < 0], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = all_ids[rows, order], all_far[rows, order], all_old[rows, order]
        ids[~np.isfinite(dist)] = -1
        active = active[~done[active].all(axis=1)]
    return ids, dist


def robust_prune(points: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours per row of candidates; dist: squared distances to the row's point, inf where there is none."""
    order = np.argsort(dist, axis=1, kind="stable")
    rows = np.arange(len(ids))[:, None]
    ids, dist = ids[rows, order], dist[rows, order]
    near = points[np.maximum(ids, 0)]
    near -= near[:, :1].copy()
    norms = (near * near).sum(-1)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    out = np.full((len(ids), DEGREE), -1, np.int64)
    rows = rows[:, 0]
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        alive &= ALPHA * ALPHA * between[rows, first] > dist
        alive[rows, first] = False
    return out


def _take_in(points: np.ndarray, edges: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> None:
    """Add the edges end -> source, and prune the points that then have more than WIDTH."""
    order = np.lexsort((sources, ends))
    ends, sources = ends[order], sources[order]
    at, first, count = np.unique(ends, return_index=True, return_counts=True)
    had = (edges[at] >= 0).sum(axis=1)
    fits = had + count <= WIDTH
    place = np.arange(len(ends)) - np.repeat(first, count) + np.repeat(had, count)
    direct = np.repeat(fits, count)
    edges[ends[direct], place[direct]] = sources[direct]
    for i in np.flatnonzero(~fits):  # all old and new neighbours of a point are candidates
        more = np.unique(np.r_[edges[at[i], :had[i]], sources[first[i]:first[i] + count[i]]])
        gap = _distances(points, points[at[i]][None], more[None])
        edges[at[i]] = -1
        edges[at[i], :DEGREE] = robust_prune(points, more[None], gap)[0]


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Out-edges of each vector, -1 padded, and the entry point."""
    n = len(points)
    points = Frame(points)(points)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, WIDTH), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != entry]
    at = 0
    while at < len(order):
        batch = order[at:at + min(BATCH, max(1, at))]
        at += len(batch)
        ids, dist = beam_search(points, edges, entry, points[batch], BUILD_BEAM)
        kept = robust_prune(points, ids, np.where(ids < 0, np.inf, dist))
        edges[batch, :DEGREE] = kept
        real = kept >= 0
        _take_in(points, edges, kept[real], np.repeat(batch, real.sum(axis=1)))
    return edges, entry


def usable(rows: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding): no NULL id, no vector that is NULL, empty, zero or not finite.

    A vec_id that comes with several vectors counts with the smallest one in array order.
    """
    good = (
        "vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and x = x and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    return rows.select("vec_id", "embedding").where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, place, class_id, embedding, links, entry): a graph per shard over the distinct vectors of usable() rows.

    `class_id` is the smallest vec_id of a vector; every vector is indexed.
    Shards are dealt by a digest of the vector, so they are even, and each is
    built in one task from at most about `shard_rows` vectors.
    """
    points = durable(rows.groupBy("embedding").agg(F.min("vec_id").alias("class_id")))
    shards = max(1, math.ceil(points.count() / shard_rows))
    dealt = points.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")})

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class_id").reset_index(drop=True)
        edges, entry = build(np.stack(group["embedding"].to_list()).astype(np.float64))
        return group.assign(place=np.arange(len(group)), links=[e[e >= 0].tolist() for e in edges], entry=entry)

    kind = rows.schema["embedding"].dataType.simpleString()
    shape = f"class_id long, embedding {kind}, dim int, shard int, place int, links array<int>, entry int"
    return dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(
        lambda g: grow(g)[["class_id", "embedding", "dim", "shard", "place", "links", "entry"]], shape)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, class_id, score): from every shard of the same dimension the k nearest vectors found for each (vec_id, embedding).

    Scores are Euclidean distances in double precision.  Queries meet a shard
    in blocks of about QUERY_BLOCK, each a task of its own.
    """
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    shards = index.groupBy("dim", "shard").count().select(F.col("dim").alias("d"), F.col("shard").alias("s"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.join(shards, F.col("dim") == F.col("d")).select("vec_id", "embedding", "dim", F.col("s").alias("shard"), "block")

    def run(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "class_id": [], "score": []})
        if not len(graph) or not len(asked):
            return empty
        graph = graph.sort_values("place")
        exact = np.stack(graph["embedding"].to_list()).astype(np.float64)
        frame = Frame(exact)
        points = frame(exact)
        edges = np.full((len(points), max(1, max(map(len, graph["links"])))), -1, np.int64)
        for i, links in enumerate(graph["links"]):
            edges[i, :len(links)] = links
        names, out = graph["class_id"].to_numpy(), [empty]
        for at in range(0, len(asked), BATCH):
            part = asked.iloc[at:at + BATCH]
            targets = np.stack(part["embedding"].to_list()).astype(np.float64)
            ids, _ = beam_search(points, edges, int(graph["entry"].iloc[0]), frame(targets), max(beam, k))
            gap = np.sqrt(((exact[np.maximum(ids, 0)] - targets[:, None]) ** 2).sum(axis=-1))
            gap[ids < 0] = np.inf
            order = np.lexsort((names[np.maximum(ids, 0)], gap))[:, :k]
            row = np.repeat(np.arange(len(part)), order.shape[1]).reshape(order.shape)
            real = ids[row, order] >= 0
            out.append(pd.DataFrame({"query_id": part["vec_id"].to_numpy()[row[real]], "class_id": names[ids[row, order][real]], "score": gap[row, order][real]}))
        return pd.concat(out[1:] or out)

    key = ["dim", "shard", "block"]
    return copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, class_id long, score double")


def nearest(rows: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that `is_query` (SQL) selects.

    Rows are (vec_id, embedding, ...); see usable() for those that take no part.
    Nearest first, ties to the smaller vec_id.  Copies of a vector are one node
    of the index; the k + 1 smallest ids of each node are all that an answer can
    hold.  Vectors of other dimensions are no candidates.  An empty table, or one
    without queries, gives an empty result.
    """
    points = durable(usable(rows))
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    members = points.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    members = members.withColumn("class_id", F.min("vec_id").over(Window.partitionBy("embedding"))).select("class_id", "vec_id")
    found = search(durable(build_index(points)), points.where(is_query), k + 1)
    ranked = (
        found.join(members, "class_id").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    )
    return ranked.select("query_id", "rank", "vec_id", "score")
