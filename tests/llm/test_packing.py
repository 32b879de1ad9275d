"""Pieces against the library that defines the ids; places checked one by one; counts against plain best fit and the lower bound."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import packing, queries

PATH = queries.vocabulary()


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check(bins, offsets, lengths, capacity):
    by_bin = {}
    for b, o, n in zip(bins, offsets, lengths):
        by_bin.setdefault(int(b), []).append((int(o), int(n)))
    for held in by_bin.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_bin)


@pytest.mark.parametrize("low, high", [(1, 2048), (400, 1200), (600, 760), (300, 800), (1, 30), (2048, 2048), (1100, 2000)])
def test_few_sequences(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 1500)
    plan = packing.Plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))))
    used = check(*packing.assign(lengths, plan), lengths, 2048)
    best = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert best <= used <= min(1.03 * best + 3, 1.01 * plain_best_fit(lengths.tolist(), 2048) + 3) or used <= 0.97 * plain_best_fit(lengths.tolist(), 2048)


def test_best_configuration():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes, worth = np.unique(rng.integers(3, 20, 4)), None
        worth = rng.random(len(sizes))
        best = max(float(np.dot(c, worth)) for c in np.ndindex(*(30 // s + 1 for s in sizes)) if np.dot(c, sizes) <= 30)
        value, counts = packing.best_configuration(sizes, worth, 30)
        assert abs(value - best) < 1e-9 and np.dot(counts, sizes) <= 30 and abs(np.dot(counts, worth) - best) < 1e-9


def packed(spark, rows, shape="doc_id long, text string", **more):
    return [r.asDict() for r in packing.pack(spark.createDataFrame(rows, shape), PATH, **more).collect()]


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    known, capacity = Tokenizer.from_file(PATH), 64
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 60)))) for i in range(100)]
    rows += [(100, None), (101, ""), (102, "w " * 5000), (None, "a b"), (7, "twice"), (7, "twice"), (103, "x" * 63), (104, "a" + " a" * 62), (105, "a" + " a" * 63)]
    got = packed(spark, rows, capacity=capacity)
    want = []
    for doc_id, text in rows:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, packing.END]
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)
    used = check([r["sequence_id"] for r in got], [r["offset"] for r in got], [r["length"] for r in got], capacity)
    assert used <= 1.06 * plain_best_fit([w[3] for w in want], capacity) + -(-len(want) // 40)


def test_odd_tables(spark):
    assert packed(spark, []) == []
    got = packed(spark, [("k", "a", 1, 2, 3)], "doc_id string, text string, length long, sequence_id long, shard long")
    assert [(r["doc_id"], r["length"], r["offset"]) for r in got] == [("k", 2, 0)]
