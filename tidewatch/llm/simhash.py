"""Near-duplicate texts by SimHash and a hierarchical index in Gray order.

Fingerprints within three bits of each other agree on two of five blocks, so the
index has one top node per masked pattern of two blocks and only members of the
same top node are ever compared.  Below it the members stand in Gray order of
their other bits, where neighbours share most of them: runs of them form nodes
that hold the bits all members share, and upper nodes hold what their children
share.  A pair of nodes is dropped as a whole once the shared bits alone differ
in more than three places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import components, join_skewed
from tidewatch.session import durable

from .common import fresh

SHINGLE = 3
DISTANCE = 3
#: Widths of the five blocks, from the top bit down.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a top node that one task takes; larger ones are split by Gray prefix.
SPLIT = 4096
#: Members of the lowest index nodes, and children of the upper ones.
LEAF, FAN = 16, 8


def hashes_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles in order, repeats included; a text of fewer words is one shingle, one without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts)), repeat(42)), dtype="<u8")


def code_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[start:start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0]) if len(hashes) else 0


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text; 0 without a word."""
    return code_of(hashes_of(text, shingle))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash over the word shingles of an A-Z lower-cased text.

    Repeated shingles count each time; a text of fewer words is one shingle, a
    NULL, empty or blank one has fingerprint 0.
    """

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint_of(t, shingle)).astype("int64")

    return run(text)


def gray_rank(code: str) -> Column:
    """Where the code of a column stands in the reflected Gray sequence."""
    return F.expr(f"aggregate(array(1, 2, 4, 8, 16, 32), {code}, (c, s) -> c ^ shiftrightunsigned(c, s))")


def _tables() -> list[tuple[int, list[tuple[int, int]]]]:
    """Per table: the mask of its two agreeing blocks, and the other blocks as (shift, width)."""
    places, at = [], 64
    for width in BLOCKS:
        at -= width
        places.append((at, width))
    out = []
    for pair in combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE):
        mask = sum(((1 << places[i][1]) - 1) << places[i][0] for i in pair)
        out.append((mask - (1 << 64) if mask >> 63 else mask, [places[i] for i in range(len(BLOCKS)) if i not in pair]))
    return out


def _top_nodes(codes: DataFrame) -> DataFrame:
    """Every fingerprint once under each of its ten masked patterns, with the Gray rank of its other bits."""
    entries = []
    for number, (mask, rest) in enumerate(_tables()):
        packed = F.lit(0).cast("long")
        for shift, width in rest:
            packed = F.shiftleft(packed, width).bitwiseOR(
                F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        entries.append(F.struct(F.lit(number).alias("t"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key"),
                                packed.alias("rest")))
    spread = codes.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.*", "fp")
    return spread.select("t", "key", gray_rank("rest").alias("gray"), "fp")


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, after adding the edges a-b."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(labels, jumped := labels[labels]):
            labels = jumped
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def _children(pairs: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of node pairs, each unordered pair once."""
    left, right = (np.repeat(p * FAN, FAN * FAN) for p in pairs)
    step = np.arange(FAN * FAN)
    left, right = left + np.tile(step // FAN, len(pairs[0])), right + np.tile(step % FAN, len(pairs[0]))
    keep = (left <= right) & (right < size)
    return left[keep], right[keep]


def linked(codes: np.ndarray) -> np.ndarray:
    """For each code of one top node, in Gray order, the index of the first code it is linked to, directly or not."""
    n = len(codes)
    labels = np.arange(n)
    levels, all_, any_ = [], codes, codes
    width = LEAF
    while True:
        starts = np.arange(0, len(all_), width)
        all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
        levels.append((all_, ~(all_ ^ any_)))
        if len(all_) <= FAN:
            break
        width = FAN
    stack = [(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 4096:
            stack += [(level, i[4096:], j[4096:])]
            i, j = i[:4096], j[:4096]
        pattern, shared = levels[level]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & shared[i] & shared[j]) <= DISTANCE
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level:
            stack.append((level - 1, *_children((i, j), len(levels[level - 1][0]))))
            continue
        starts = np.arange(0, n, LEAF)
        low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        todo = (low[i] != high[j]) | (high[i] != low[j])  # else all members are of one component already
        i, j = i[todo], j[todo]
        step = np.arange(LEAF * LEAF)
        a = np.repeat(i * LEAF, LEAF * LEAF) + np.tile(step // LEAF, len(i))
        b = np.repeat(j * LEAF, LEAF * LEAF) + np.tile(step % LEAF, len(j))
        inside = (a < b) & (b < n)
        a, b = a[inside], b[inside]
        close = np.bitwise_count(codes[a] ^ codes[b]) <= DISTANCE
        labels = _settle(labels, a[close], b[close])
    return labels


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links of every top node; rows come sorted by (t, key, gray)."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        codes = frame["fp"].to_numpy().view(np.uint64)
        t, key = frame["t"].to_numpy(), frame["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(codes)])
        group = np.repeat(np.arange(len(starts)), sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = sizes <= LEAF  # a single leaf: its pairs at each offset, all groups at once
        for off in range(1, min(LEAF, int(sizes.max()))):
            i = np.flatnonzero((group[off:] == group[:-off]) & small[group[off:]])
            i = i[np.bitwise_count(codes[i] ^ codes[i + off]) <= DISTANCE]
            a.append(i)
            b.append(i + off)
        for g in np.flatnonzero(~small):
            at = starts[g]
            labels = linked(codes[at:at + sizes[g]])
            i = np.flatnonzero(labels != np.arange(sizes[g]))
            a.append(at + labels[i])
            b.append(at + i)
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": codes[a].view(np.int64), "b": codes[b].view(np.int64)})

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        same = ((batch["t"] == last["t"]) & (batch["key"] == last["key"])).to_numpy()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if not cut and rest and (rest[-1].iloc[-1][["t", "key"]] == last[["t", "key"]]).all():
            rest.append(batch)
            continue
        yield solve(pd.concat([*rest, batch[:cut]]) if cut else pd.concat(rest)) if cut or rest else batch[:0][["fp"]].assign(a=0, b=0)[["a", "b"]]
        rest = [batch[cut:]]
    if rest:
        yield solve(pd.concat(rest))


def _linked_within(rows: DataFrame) -> DataFrame:
    return rows.repartition("t", "key").sortWithinPartitions("t", "key", "gray").mapInPandas(_links, "a long, b long")


def _split(rows: DataFrame) -> DataFrame:
    """Large top nodes as pairs of smaller nodes: each fits a task, no linked pair is lost.

    Nodes are the shortest Gray prefixes of at most SPLIT members.  Two of them
    meet in a task of their own unless the bits each shares already differ in
    more than three places.
    """
    width, prefixes = 39, (6, 12, 18, 24, 30, 36, 39)
    levels = F.array(*(F.struct(F.lit(p).alias("p"), F.shiftrightunsigned("gray", width - p).alias("prefix")) for p in prefixes))
    counted = (
        rows.select("t", "key", F.explode(levels).alias("e")).groupBy("t", "key", "e").count()
        .where((F.col("count") <= SPLIT) | (F.col("e.p") == width)).select("t", "key", "e")
    )
    placed = (
        rows.withColumn("e", F.explode(levels)).join(counted, ["t", "key", "e"])
        .groupBy("t", "key", "gray", "fp").agg(F.min("e").alias("e"))
    )
    placed = durable(placed.withColumn("node", F.xxhash64("t", "key", "e")))
    nodes = placed.groupBy("t", "key", "node").agg(
        F.expr("bit_and(fp)").alias("pattern"), F.expr("~(bit_or(fp) ^ bit_and(fp))").alias("shared"))
    other = nodes.select("t", "key", F.col("node").alias("node2"), F.col("pattern").alias("pattern2"), F.col("shared").alias("shared2"))
    pairs = nodes.join(other, ["t", "key"]).where(
        "node <= node2 and bit_count((pattern ^ pattern2) & shared & shared2) <= " + str(DISTANCE))
    ends = pairs.select(F.xxhash64("node", "node2").alias("pair"), F.explode(F.array_distinct(F.array("node", "node2"))).alias("node"))
    return placed.join(ends, "node").select("t", F.col("pair").alias("key"), "gray", "fp")


def near_links(codes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` exactly as all pairs within three bits would.

    Inside a node the links form stars, so a dense group gives as many links as
    members.  Order, repeats and partitioning of the input don't matter.
    """
    rows = _top_nodes(codes.select("fp").where("fp is not null").distinct())
    sizes = rows.groupBy("t", "key").count().where("count > 1")
    crowded = durable(sizes.where(F.col("count") > SPLIT).select("t", "key"))
    links = _linked_within(rows.join(crowded, ["t", "key"], "left_anti"))
    if crowded.isEmpty():
        return links
    return links.union(_linked_within(_split(rows.join(crowded, ["t", "key"], "left_semi"))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every row of (doc_id, text, ...) with `fingerprint` and `component_id`; further columns are dropped.

    Rows are linked when their fingerprints differ in at most three bits.
    `component_id` is the smallest doc_id reachable over links, the row's own
    included; NULL if every doc_id of the component is NULL.  Copies share a
    fingerprint and meet as one node.  NULL, empty and blank texts have
    fingerprint 0 and are linked like any other.  Repeated rows stay repeated;
    an empty table gives an empty one.
    """
    rows = durable(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    return label(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def label(rows: DataFrame) -> DataFrame:
    """`component_id` for rows of (doc_id, fp), see near_duplicates, and `root`, the component's own key."""
    first = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(first))
    marked = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = marked.groupBy("root").agg(F.min("first").alias("component_id"))
    return join_skewed(rows, join_skewed(marked, least, "root").select("fp", "root", "component_id"), "fp", "left")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, with all its columns.

    Of several rows with that doc_id, or of a group without any doc_id, one row
    stays.  A NULL text counts as an empty one.  Groups are found on narrow
    rows; the texts are shuffled once, by doc_id, to meet the decisions.
    """
    fp, number, missing = fresh(docs, "fp", "number", "missing")
    hashed = docs.withColumns({
        fp: fingerprint(F.col("text"), shingle), number: F.coalesce("doc_id", F.lit(0)), missing: F.col("doc_id").isNull()})
    rows = durable(hashed.select("doc_id", F.col(fp).alias("fp")))
    kept = (
        label(rows).where("doc_id <=> component_id").groupBy("root").agg(F.min("fp").alias(fp), F.first("doc_id").alias("doc_id"))
        .select(fp, F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(missing))
    )
    key = [number, missing, fp]
    return hashed.join(kept, key, "left_semi").dropDuplicates(key).select(*(F.col(f"`{c}`") for c in docs.columns))
