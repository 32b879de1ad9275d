"""Packing documents into sequences of a fixed number of tokens by linear grouping.

The lengths of all pieces are counted.  Large ones are put into groups of about
equal cardinality and rounded up to the largest of their group, which leaves a
few sizes only.  For these the driver finds the mix of configurations (how many
pieces of each size share a sequence) that needs the fewest sequences, by a
linear program whose columns are generated as they pay.  Tasks then substitute
actual pieces for the rounded sizes, and what is left, the small pieces above
all, goes by best fit into the room that rounding and configurations leave.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable

from . import bpe

CAPACITY = 2048
#: The token that ends a document.
END = 0
#: Rounded sizes; a piece of up to this share of a sequence is small; pieces that one task packs.
GROUPS, SMALL, SHARD = 64, 1 / 8, 1 << 16
#: Steps of the linear program; stopping early gives a valid plan of more sequences.
STEPS = 3000


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits into a sequence, and how many pieces of each size give it."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist())):
        if value <= 0:
            continue
        before = best.copy()
        for n in range(1, capacity // size + 1):
            better = before[:capacity + 1 - n * size] + n * value
            at = np.flatnonzero(better > best[n * size:] + 1e-12) + n * size
            best[at] = better[at - n * size]
            taken[i, at] = n
    room, counts = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = taken[i, room]
        room -= int(counts[i] * sizes[i])
    return float(best[capacity]), counts


def configure(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations, one a row, and how many sequences of each hold the demand in the fewest sequences (fractions)."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(STEPS):
        use = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        gain, counts = best_configuration(sizes, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, counts.astype(float))
        rate = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(rate.argmin())] = counts
    return basis.T.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand), 0)


class Plan:
    """Groups of large lengths and the configurations of their rounded sizes, from the count of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL):
        self.capacity, self.total = capacity, sum(counts.values())
        large = np.array(sorted((n for n in counts if n > capacity * small)), np.int64)
        self.group = np.full(capacity + 1, -1)
        self.sizes, self.configurations, self.use = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros(0)
        if len(large):
            many = np.array([counts[n] for n in large.tolist()], float)
            middle = (np.cumsum(many) - many / 2) / many.sum()
            number = np.unique((middle * groups).astype(int), return_inverse=True)[1]
            last = np.flatnonzero(np.r_[number[1:] != number[:-1], True])
            self.group[large] = number
            self.sizes = large[last]
            self.configurations, self.use = configure(self.sizes, np.bincount(number, many), capacity)


def _best_fit(lengths: np.ndarray, order: list[int], bins: np.ndarray, room: list[int]) -> None:
    """Put the pieces of `order`, one by one, where the least room is left; `bins` and `room` are changed."""
    by_room: dict[int, list[int]] = {}
    open_ = 0  # bit r: some sequence has room for r tokens
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        open_ |= 1 << r
    capacity = max(room, default=0)
    for i in order:
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], room[b] = b, r - n
        by_room.setdefault(r - n, []).append(b)
        open_ |= 1 << (r - n)


def assign(lengths: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and an offset for each length of one shard."""
    bins, room = np.full(len(lengths), -1, np.int64), []
    of_length: dict[int, list[int]] = {}
    there = 0  # bit n: a large piece of n tokens has no place yet
    for i in np.argsort(-lengths, kind="stable").tolist():
        if plan.group[lengths[i]] >= 0:
            of_length.setdefault(int(lengths[i]), []).append(i)
            there |= 1 << int(lengths[i])
    low = np.r_[0, plan.sizes[:-1]] + 1
    spans = [((1 << int(high) + 1) - (1 << int(a))) for a, high in zip(low, plan.sizes)]
    share = len(lengths) / max(plan.total, 1)
    for p in np.argsort(-plan.use, kind="stable"):
        slots = np.repeat(np.arange(len(plan.sizes)), plan.configurations[p])[::-1].tolist()
        for _ in range(int(plan.use[p] * share + 1e-6)):
            left, held = plan.capacity, []
            for g in slots:
                # all but the last are of their group; the last is the largest that fits
                fits = there & spans[g] if len(held) + 1 < len(slots) else there & (1 << left + 1) - 1
                if not fits:
                    break
                n = fits.bit_length() - 1
                held.append(of_length[n].pop())
                if not of_length[n]:
                    there ^= 1 << n
                left -= n
            if held:
                bins[held] = len(room)
                room.append(left)
    by_length = np.argsort(-lengths, kind="stable")
    rest = by_length[bins[by_length] < 0].tolist()
    _best_fit(lengths, rest, bins, room := [*room, plan.capacity] if rest else room)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    return bins, offsets


def counted(text: Column, path: str, capacity: int = CAPACITY) -> Column:
    """Struct of a document's token count, its end token included, and the CRC-32 of each piece's ids.

    Only documents of more than `capacity` tokens have several pieces; all but
    the first hold `capacity` tokens.  A NULL text counts as an empty one.
    """

    @F.pandas_udf("n long, crcs array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = bpe.encoder(path)
        for texts in batches:
            sizes, crcs = [], []
            for ids in own.encode_all(texts):
                ids = np.append(ids, END).astype("<u4")
                cuts = list(range((len(ids) - 1) % capacity + 1, len(ids), capacity))
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *cuts], [*cuts, len(ids)])])
            yield pd.DataFrame({"n": np.array(sizes, np.int64), "crcs": pd.Series(crcs, dtype=object)})

    return run(text)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document, tokens counted once and kept in the shared folder."""
    found = durable(docs.select("doc_id", counted(F.col("text"), path, capacity).alias("c")).select("doc_id", "c.*"))
    cut = found.select("doc_id", "n", F.size("crcs").alias("k"), F.posexplode("crcs").alias("at", "ids_crc32"))
    start = F.when(F.col("at") == 0, 0).otherwise(F.col("n") - (F.col("k") - F.col("at")) * capacity).cast("long")
    length = F.when(F.col("at") == 0, F.col("n") - (F.col("k") - 1) * capacity).otherwise(capacity).cast("long")
    return cut.select("doc_id", F.col("at").cast("int").alias("piece"), start.alias("start"), length.alias("length"), "ids_crc32")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of (doc_id, text, ...) with the sequence that holds it and its offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset;
    further columns are dropped.  The pieces of a sequence follow each other
    without a gap and have at most `capacity` tokens.  NULL and empty texts are
    one piece, the end token.  Repeated rows, and rows without a doc_id, are
    documents of their own; an empty table gives an empty one.  The driver gets
    the count of each length, `capacity` rows at most.  Pieces are dealt to
    shards of about SHARD whatever their doc_id, and each shard follows the same
    plan; all but about one sequence of a shard are as full as in a single one.
    """
    rows = pieces(docs, path, capacity)
    plan = Plan({r.length: r["count"] for r in rows.groupBy("length").count().collect()}, capacity)
    shards = -(-plan.total // SHARD) or 1

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        bins, offsets = assign(frame["length"].to_numpy(), plan)
        return frame.drop(columns="shard").assign(sequence_id=bins + (shard << 32), offset=offsets)

    shape = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", sequence_id long, offset long"
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fill, shape)
