"""Connected components of an undirected graph, as alternating star contractions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Edges for a task: a round of a small graph runs in few tasks, however many partitions a shuffle has.
EDGES_A_TASK = 4096


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one key that may hold a third of the left rows.

    The second, derived key keeps either side from arriving already partitioned
    by an aggregate, so adaptive execution sees two plain exchanges and may
    split a hot partition of either.
    """
    twin = f"twin_{uuid.uuid4().hex[:8]}"
    return left.withColumn(twin, F.xxhash64(key)).join(right.withColumn(twin, F.xxhash64(key)), [key, twin], how).drop(twin)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    near = join_skewed(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return near.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; every edge has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    lower = join_skewed(edges, least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.coalesce(tasks).union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that some edge (a, b) names; the root is the component's smallest node.

    Loops, repeated edges and NULL ends are ignored; an empty edge table gives
    an empty result.  Both steps reduce per node on the map side and join on
    keys that adaptive execution can split, so a hub needs no task of its own.
    The lineage is cut in the shared checkpoint folder after each round, of
    which there are O(log^2 n).  A round's tasks follow the number of its edges:
    files of shuffles and checkpoints are counted in tasks, not in rows, where a
    graph is small.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, seen = durable(edges.distinct()), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, tasks = now, -(-now[0] // EDGES_A_TASK)
        current = durable(_small_star(_large_star(current.coalesce(tasks), tasks), tasks))
