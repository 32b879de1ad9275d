"""Connected components of small graphs under many shuffle partitions."""

from tidewatch.operators import components


def test_tasks_follow_the_edges(spark, monkeypatch):
    """A round's table has as many parts as its edges need, not as many as a shuffle has (pipeline on check_h)."""
    kept, durable = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = [(i, i - 1) for i in range(1, 60) if i % 20] + [(100, 100 + i) for i in range(1, 300)] + [(None, 1), (7, 7)]
        found = components.components(spark.createDataFrame(rows, "a long, b long"))
        got = {r["node"]: r["root"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 400)}
    assert len(kept) > 2 and all(df.rdd.getNumPartitions() == 1 for df in kept[1:])


def test_more_edges_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_A_TASK", 50)
    rows = spark.range(1, 400).selectExpr("id a", "id - id % 40 b")
    got = {r["node"]: r["root"] for r in components.components(rows).collect()}
    assert got == {i: i // 40 * 40 for i in range(400)}
