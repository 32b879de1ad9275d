"""Targets against a plain water filling, and the mix against its own schedule."""

from collections import Counter

import pytest

from tidewatch.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    return target


SIZES = [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 50, "d": 3}, {"a": 1, None: 7, "é": 0, "Z": 40},
    {"x": 0, None: 0}, {"only": 17}, {f"s{i}": i * i for i in range(30)},
]


@pytest.mark.parametrize("sizes", SIZES, ids=range(len(SIZES)))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert {s: r.source_size for s, r in got.items()} == sizes
    for source, row in got.items():
        assert row.target == pytest.approx(want[source], abs=1e-9)


def test_points(spark):
    got = [r[0] for r in spark.range(1, 9).select(mixing.van_der_corput(mixing.F.col("id"))).collect()]
    assert got == [1 / 2, 1 / 4, 3 / 4, 1 / 8, 5 / 8, 3 / 8, 7 / 8, 1 / 16]


def corpus(spark, n=300):
    rows = [(i, "w " * (i * 37 % 90), ["big", "mid", None, "Low"][0 if i % 3 == 0 else i % 4], "x", i) for i in range(n)]
    rows += [(5, "again again", "big", "x", 1), (5, "again again", "big", "x", 1), (None, "no id here", "mid", None, None),
             (900, None, "mid", "y", 1), (901, "", None, "y", 1), (902, "long " * 30_000, "Low", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target long")


def test_mix(spark):
    docs = corpus(spark)
    rows = mixing.mix(docs, block_words=64).collect()
    assert len(rows) == docs.count()
    taken, goal = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    for source, target in goal.items():
        assert abs(taken[source] - target) <= 0.5
    again = mixing.mix(docs.repartition(7), block_words=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_schedule_keeps_shares_all_along(spark):
    docs = spark.createDataFrame([(i, "w " * 50, ["a", "b", "c"][i % 3]) for i in range(600)], "doc_id long, text string, source string")
    goals = mixing.targets(docs.select("source", mixing.n_words(mixing.F.col("text")).alias("size")))
    slots = sorted(mixing.schedule(mixing.durable(goals), 100).collect())
    shares = {r.source: r.target for r in goals.collect()}
    whole, seen = sum(shares.values()), Counter()
    for i, slot in enumerate(slots, 1):
        assert slot.turn == seen[slot.source]
        seen[slot.source] += 1
        assert all(abs(seen[s] - i * shares[s] / whole) <= 8 for s in shares)


def test_the_mix_follows_the_schedule(spark):
    """Blocks of the mix add up to what is taken of each document, and any stretch of slots holds the sources by their shares."""
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = mixing.mixture(docs, block_words=32).collect()
    taken = {}
    for r in parts:
        assert 0 <= r.start and r.words > 0 and r.start + r.words <= r.size
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    whole = {r.doc_id: r for r in mixing.mix(docs, block_words=32).collect()}
    assert taken == {k: r.taken for k, r in whole.items() if r.taken}
    target = {r.source: r.target for r in whole.values()}
    last = max(r.slot for r in parts)
    for low in range(0, last // 2, last // 8):
        here = {}
        for r in parts:
            if low < r.slot <= low + last // 4:
                here[r.source] = here.get(r.source, 0) + r.words
        for name, goal in target.items():
            assert abs(here[name] / sum(here.values()) - goal / sum(target.values())) < 0.04


def test_documents(spark):
    docs = corpus(spark)
    out = mixing.mixed_documents(docs, block_words=64)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    taken = {}
    for r in mixing.mix(docs, block_words=64).collect():
        taken.setdefault(r.doc_id, []).append((r.taken, r.size))
    for doc_id, parts in taken.items():
        if len(parts) == 1:
            (t, size), = parts
            assert got[doc_id] == (round(t / size + 1e-12) if size else 0) or abs(t / size % 1 - 0.5) < 1e-9


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
