"""Gradients against differences, scores against a plain sum, and what training must learn."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import lm


def test_windows():
    assert lm.windows(np.array([7, 8, 9], np.int16)).tolist() == [
        [lm.EDGE, lm.EDGE, 8, 9, 7], [lm.EDGE, 7, 9, lm.EDGE, 8], [7, 8, lm.EDGE, lm.EDGE, 9]]
    assert lm.windows(np.array([7, 8, 9], np.int16), np.array([1])).tolist() == [[lm.EDGE, 7, 9, lm.EDGE, 8]]


def test_gradient():
    rng = np.random.default_rng(0)
    flat = rng.standard_normal(sum(int(np.prod(s)) for s in lm._shapes())) * 0.2
    rows = rng.integers(0, lm.CLASSES, (20, 2 * lm.REACH + 1))
    slope = np.concatenate([x.ravel() for x in lm.gradient(lm._split(flat), rows)[1]])
    for i in [*np.argsort(-np.abs(slope))[:10], *rng.integers(0, len(flat), 5)]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((lm.gradient(lm._split(up), rows)[0] - lm.gradient(lm._split(down), rows)[0]) / 2e-5 - slope[i]) < 1e-6


def by_hand(model, text):
    inward, bias, upper, upper_level, lower, lower_level = (x.astype(float) for x in lm._split(model.weights))
    words = text.encode().lower().split()
    ids = [model.frequent.get(w, lm.FREQUENT + lm.slot_of(w) // lm.SLOTS) for w in words]
    total = 0.0
    for i, own in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else lm.EDGE for j in range(i - lm.REACH, i + lm.REACH + 1) if j != i]
        hidden = np.tanh(bias + sum(inward[p][c] for p, c in enumerate(around)))
        for logits, at in ((hidden @ upper + upper_level, own // 16), (hidden @ lower[own // 16] + lower_level[own // 16], own % 16)):
            total += logits[at] - np.log(np.exp(logits).sum())
        if words[i] not in model.frequent:
            total += model.within[lm.FREQUENT + lm.slot_of(words[i])]
    return len(ids), total


def test_scores_and_training(spark, monkeypatch):
    monkeypatch.setattr(lm, "MASKED", 2)
    rng = np.random.default_rng(1)
    pair = {"red": "apple", "blue": "sky", "green": "leaf"}
    text = lambda swap: " ".join(f"{a} {pair[a] if not swap else list(pair.values())[rng.integers(3)]} ." for a in rng.choice(list(pair), 60))
    rows = [(i, text(False)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm.fit(docs)
    probe = [(0, rows[0][1]), (1, text(True)), (2, None), (3, ""), (4, "Lone"), (5, "red apple " * 20_000)]
    got = {r.doc_id: r.s for r in spark.createDataFrame(probe, "doc_id long, text string").select("doc_id", lm.score(F.col("text"), model).alias("s")).collect()}
    for i in (0, 1, 4):
        n, total = by_hand(model, probe[i][1])
        assert got[i].n_tokens == n and abs(got[i].score - total) < 1e-3 * n
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].score == got[3].score == 0.0
    assert got[5].n_tokens == 40_000
    assert got[0].score / 180 > -0.8 and got[1].score < got[0].score - 20


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(empty)
    assert empty.select(lm.score(F.col("text"), model)).count() == 0


def test_every_position_is_masked():
    for size in [*range(1, 34), 100]:
        for start in (0, 7, 2**32 - 1):
            rounds = [lm.masked(size, start, number, lm.MASKED).tolist() for number in range(lm.MASKED)]
            assert all(rounds) and {at for r in rounds for at in r} == set(range(size))
    assert not len(lm.masked(0, 5, 0, lm.MASKED))


def test_stored_blocks_mask_the_same(spark):
    for size in (1, 5, 31, 32, 33, 100):
        for start in (0, 7, 2**32 - 1):
            when = lm.phases(size, start, lm.MASKED)
            classes = np.arange(size).astype("<i2")
            for number in range(lm.MASKED):
                got = lm.chosen(classes.tobytes(), when.tobytes(), number)
                assert got[:, -1].tolist() == lm.masked(size, start, number, lm.MASKED).tolist()


def test_words_count(spark):
    """Within a class, probabilities add up to one; a word of the corpus is likelier than an invented one of the same ending."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x}ing" for x in rng.integers(0, 60, 300)) + " solo" for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(t, "k") for t in texts + texts[:1]], "text string, word string").repartition(3)
    frequent, within = lm.vocabulary(docs)
    assert frequent[b"solo"] in range(lm.FREQUENT) and len(frequent) == 61
    assert np.allclose(np.exp(within[lm.FREQUENT:].astype(float)).reshape(lm.ENDINGS, -1).sum(axis=1), 1, atol=1e-3)
    many = spark.createDataFrame([(" ".join(f"w{x}ing" for x in range(400)),), (" ".join(f"w{x}ing" for x in range(300)),)], "text string")
    model = lm.fit(many, rounds=1)
    seen, invented = ([w for w in words if w not in model.frequent] for words in ([b"w350ing", b"w351ing", b"w352ing"], [b"zq9ing", b"zq8ing", b"zq7ing"]))
    value = lambda w: model.within[lm.FREQUENT + lm.slot_of(w)]
    assert seen and min(map(value, seen)) > max(map(value, invented))


def test_repeated_rows_and_order(spark):
    rows = [(i, f"some words that repeat {i % 3}", "x") for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, score string").coalesce(1)
    one, two = lm.fit(docs, rounds=2), lm.fit(docs, rounds=2)
    assert one.weights.tolist() == two.weights.tolist() and one.within.tolist() == two.within.tolist()


def test_short_texts_and_edges_train(spark):
    """With MASKED as shipped, texts of fewer words train, the class after the end included."""
    texts = [" ".join(["red", "apple", "falls"][i % 3] for i in range(n)) for n in range(1, 32)]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    before = lm._split((np.random.default_rng(0).standard_normal(sum(int(np.prod(s)) for s in lm._shapes())) * 0.1).astype(np.float32))[0]
    for place in range(2 * lm.REACH):
        assert abs(lm._split(model.weights)[0][place][lm.EDGE] - before[place][lm.EDGE]).max() > 0.01
