"""Recall and exact distances against brute force."""

import math
import os

import numpy as np
import pytest

from tidewatch.llm import ann, queries

FOLDER = "/root/testdata/sf0.01"


def brute(rows, k, is_query):
    out = {}
    for q, v in rows:
        if is_query(q):
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out[q] = near
    return out


def recall(got, want):
    hits = total = 0
    for q, near in want.items():
        worst = near[-1][0] + 1e-9
        hits += sum(r.score <= worst for r in got if r.query_id == q)
        total += len(near)
    return hits / total


def check_order(got, vectors):
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(math.dist(vectors[r.query_id], vectors[r.vec_id]), rel=1e-12)
    for rows in by_query.values():
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        keys = [(r.score, r.vec_id) for r in rows]
        assert keys == sorted(keys) and len({r.vec_id for r in rows}) == len(rows) and all(r.vec_id != r.query_id for r in rows)
    return by_query


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ann.build_index, "__defaults__", (300,))
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((10, 24))
    rows = [(i, (centres[i % 10] + 0.5 * rng.standard_normal(24)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id % 20 = 0").collect()
    assert len(check_order(got, dict(rows))) == 60 and len(got) == 600
    assert recall(got, brute(rows, 10, lambda i: i % 20 == 0)) >= 0.95


@pytest.mark.parametrize("kind", ["offset", "huge", "tiny", "clusters", "far query"])
def test_recall_wherever_vectors_lie(spark, monkeypatch, kind):
    monkeypatch.setattr(ann.build_index, "__defaults__", (400,))
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1200, 32))
    x = {"offset": x + 1000, "huge": x * 1e20, "tiny": x * 1e-20, "far query": x,
         "clusters": rng.standard_normal((12, 32))[np.arange(1200) % 12] + 1e-4 * x}[kind]
    if kind == "far query":
        x[0] = x[1] * 1e25
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 40 = 0").collect()
    assert len(check_order(got, dict(rows))) == 30 and len(got) == 300
    assert recall([r for r in got if r.query_id], brute(rows, 10, lambda i: i and i % 40 == 0)) >= 0.95


def test_odd_rows(spark):
    same, rows = [1.0, 0.0, 2.0], [(i, [float(i), 1.0, -float(i % 3)]) for i in range(1, 40)]
    rows += [(100 + i, same) for i in range(30)] + [(7, rows[6][1])]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [1.0, float("inf"), 1.0]), (205, []),
           (None, [1.0, 2.0, 3.0]), (300, [1.0, 2.0]), (400, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, shard int, rank int")
    got = ann.nearest(df, "vec_id in (20, 100, 110, 200, 201, 300)").collect()
    by_query = check_order(got, dict(rows + bad))
    assert {q: len(r) for q, r in by_query.items()} == {20: 10, 100: 10, 110: 10, 300: 1}
    assert [r.vec_id for r in by_query[100]] == list(range(101, 111)) and [r.vec_id for r in by_query[110]] == list(range(100, 110))
    want = brute(list(dict(rows).items()), 10, lambda i: i == 20)
    assert [(r.vec_id) for r in by_query[20]] == [i for _, i in want[20]]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, "vec_id % 20 = 0").count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, "vec_id % 20 = 0").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_supplied_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = queries.op9_neighbours(spark, FOLDER).collect()
    check_order(got, dict(rows))
    assert recall(got, brute(rows, 10, lambda i: i % 100 == 0)) >= 0.9
