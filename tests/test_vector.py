import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import vector


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(0, 8, 400)]
    q = x[:30] + 0.1 * rng.normal(size=(30, 16))
    urls = [f"u{i // 3}" if i % 10 else None for i in range(400)]
    corpus = spark.createDataFrame([(i, urls[i], v.tolist()) for i, v in enumerate(x)], "id long, url string, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    return x, q, urls, corpus.repartition(5), queries


def brute(x, q, urls, k):
    xn, qn = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, q))
    out = {}
    for i, row in enumerate(1 - qn @ xn.T):
        seen, best = set(), []
        for j in np.lexsort((np.arange(len(x)), np.floor(row * 1e6 + 0.5))):
            if urls[j] not in seen:
                seen.add(urls[j])
                best.append(int(j))
            if len(best) == k:
                break
        out[i] = best
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact(data):
    x, q, urls, corpus, queries = data
    assert found(vector.knn(queries, corpus, 7)) == brute(x, q, urls, 7)


def test_large_batches_use_blocks_with_the_same_result(data, monkeypatch):
    x, q, urls, corpus, queries = data
    monkeypatch.setattr(vector, "MAX_BROADCAST_QUERIES", 10)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 90)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 8)
    assert found(vector.knn(queries, corpus, 7)) == brute(x, q, urls, 7)


def test_bucketed_recall(data):
    x, q, urls, corpus, queries = data
    exact = brute(x, q, urls, 5)
    some = found(vector.knn_bucketed(queries, corpus, 5, lists=8, probes=3))
    hits = sum(len(set(exact[i]) & set(some.get(i, []))) for i in exact)
    assert hits / (5 * len(exact)) > 0.8
    every = found(vector.knn_bucketed(queries, corpus, 5, lists=8, probes=8))
    assert every == exact


def test_bucketed_search_does_not_depend_on_the_batch_size(data, monkeypatch):
    x, q, urls, corpus, queries = data
    small = found(vector.knn_bucketed(queries, corpus, 5, lists=16, probes=1))
    monkeypatch.setattr(vector, "MAX_BROADCAST_QUERIES", 10)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 90)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 8)
    assert found(vector.knn_bucketed(queries, corpus, 5, lists=16, probes=1)) == small != brute(x, q, urls, 5)


def test_queries_without_a_vector(spark, data):
    x, q, urls, corpus, queries = data
    more = queries.unionByName(spark.createDataFrame([(900, None), (901, [])], "query_id long, embedding array<double>"))
    assert found(vector.knn(more, corpus, 7)) == brute(x, q, urls, 7)


def test_no_queries_and_null_embeddings(spark, data):
    _, _, _, corpus, queries = data
    assert vector.knn(queries.filter("false"), corpus, 3).count() == 0
    none = corpus.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert vector.knn(queries, none, 3).count() == 0


def test_kept_index(spark, data, tmp_path, monkeypatch, capfd):
    """Batches add up to the whole corpus, a replay changes nothing, and a search trains nothing and reads probed lists only."""
    x, q, urls, corpus, queries = data
    path = str(tmp_path / "index")
    vector.write_index(corpus.filter("id < 250"), path, 8)
    for _ in range(2):
        vector.append_index(corpus.filter("id >= 250"), path, 1)
    assert spark.read.parquet(f"{path}/rows").count() == 400
    monkeypatch.setattr(vector, "coarse_centroids", lambda *a: pytest.fail("trained again"))
    exact = brute(x, q, urls, 5)
    assert found(vector.knn_index(queries, path, 5, probes=8)) == exact
    some = found(vector.knn_index(queries, path, 5, probes=4))
    assert sum(len(set(exact[i]) & set(some.get(i, []))) for i in exact) / (5 * len(exact)) >= 0.9
    one = vector.knn_index(queries.limit(1), path, 5, probes=1)
    one.explain("formatted")
    plan = capfd.readouterr().out
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan
    near = vector.assign_lists(queries.limit(1), vector.index_centres(spark, path))
    only = near.first()["list"]
    assert {r.id for r in one.collect()} <= {r.id for r in spark.read.parquet(f"{path}/rows").filter(F.col("list") == only).collect()}


def test_kept_index_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    vector.write_index(rows, path, 4)
    asked = spark.createDataFrame([(7, [0.0, 2.0]), (8, None), (9, [])], "query_id long, embedding array<double>")
    got = vector.knn_index(asked, path, 2, probes=4).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(7, 3), (7, 1)]
    assert vector.knn_index(asked.filter("query_id > 7"), path, 2).count() == 0
