"""Runs against all pairs of positions, transforms against plain sums, and the query against its definition."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import periodic, queries

FOLDER = "/root/testdata/sf0.001"


def brute(x):
    out = []
    for q in range(1, len(x) // 2 + 1):
        same = np.diff(np.r_[0, x[q:] == x[:-q], 0].astype(int))
        for s, e in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1)):
            part = x[s:e + q]
            if len(part) >= max(12, 2 * q) and not any(np.array_equal(part[k:], part[:-k]) for k in range(1, q)):
                out.append((int(s), len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def cases():
    rng = np.random.default_rng(0)
    for i in range(250):
        n = int(rng.integers(0, 140))
        x = rng.integers(0, rng.integers(1, 5), n)
        if i % 3 == 0 and n > 20:
            a = int(rng.integers(0, n))
            x = rng.integers(0, 1000, n)
            x[a:] = x[a + np.arange(n - a) % (1 + (n - a) // int(rng.integers(3, 11)))]
        if i % 7 == 0:
            x = np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 20))
        yield x
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield np.array(b)
    yield np.zeros(700, int)
    x = rng.integers(0, 10**6, 3000)
    x[700:] = x[700 + np.arange(2300) % 900]
    yield x


def test_runs():
    texts = [x.astype(np.int64) for x in cases()]
    assert periodic.find_runs(texts) == [brute(x) for x in texts]
    assert [periodic.find_runs([x])[0] for x in texts[:40]] == [brute(x) for x in texts[:40]]


@pytest.mark.parametrize("longest, direct, held", [(16, 4, 64), (64, 16, 1 << 10)])
def test_blocks_longer_than_a_transform(monkeypatch, longest, direct, held):
    monkeypatch.setattr(periodic, "LONGEST", longest)
    monkeypatch.setattr(periodic, "DIRECT", direct)
    monkeypatch.setattr(periodic, "HELD", held)
    texts = [x.astype(np.int64) for x in cases()][-60:]
    assert periodic.find_runs(texts) == [brute(x) for x in texts]


@pytest.mark.parametrize("n", [2, 16, 128, 256, 2048, 1 << 15])
def test_transform(n):
    x = np.random.default_rng(n).integers(0, periodic.PRIME, (2, n))
    got = periodic.transform(periodic._mod(x.astype(float)))
    w = pow(periodic.ROOT, (periodic.PRIME - 1) // n, periodic.PRIME)
    for k in (0, 1, n // 2, n - 1):
        assert int(got[1, k]) % periodic.PRIME == sum(int(v) * pow(w, k * i % n, periodic.PRIME) for i, v in enumerate(x[1])) % periodic.PRIME
    back = periodic.transform(got, inverse=True)
    assert ((back.astype(np.int64) - x * n) % periodic.PRIME == 0).all()


def test_every_period_has_a_scale():
    for longest in (12, 13, 100, 999):
        covered = [q for _, low, high in periodic.scales(longest) for q in range(low, high + 1)]
        assert covered == list(range(1, longest // 2 + 1))
    for q in range(1, 500):  # wherever the shortest run begins, it holds an aligned block and its copy
        size = periodic.scale_of(q)
        assert max(12, 2 * q) - q >= 2 * size - 1


def test_columns(spark):
    loop = "a b c d " * 5
    rows = [(None,), ("",), (" \n",), ("one two",), (f"x {loop}y",), ("é " * 12 + "z",), ("w " * 40_000,)]
    got = [r.f for r in spark.createDataFrame(rows, "text string").select(periodic.runs(F.col("text")).alias("f")).collect()]
    assert [[tuple(r) for r in g.runs] for g in got] == [[], [], [], [], [(1, 20, 4)], [(0, 12, 1)], [(0, 40_000, 1)]]
    assert [g.collapsed for g in got] == ["", "", "", "one two", "x a b c d y", "é z", "w"]
    assert spark.createDataFrame([], "text string").select(periodic.runs(F.col("text"))).count() == 0


def by_definition(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    numbers = {}
    runs = brute(np.array([numbers.setdefault(w, len(numbers)) for w in words], int))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic"](spark, FOLDER).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 10
    for r in docs:
        if len(r.text or "") < 20_000:
            assert got[r.doc_id] == by_definition(r.doc_id, r.text), r.doc_id


def test_planted_texts_of_odd_rows(spark):
    rows = [(None, "a b"), (3, None), (3, ""), (3, " "), *((i, "a b c d e f g h i j k l m n") for i in range(60))]
    got = queries.planted(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h long"))
    assert got.columns == ["doc_id", "text"] and got.count() == len(rows)
    assert 0 < got.where("text like '%a b%' and text not like '%m n%' and doc_id is not null").count() < 20
