"""The grammar by hand, the transducers against direct rules, and held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    symbols = {w: s for s, of in (("T", toxicity.THREATS), ("Y", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS)) for w in of}
    return toxicity.Model(symbols, {"idiot": 2.0, "scum": 3.0, "lowei*": 4.0}, toxicity.grammar(), toxicity.PRIOR)


CASES = {
    "an idiot here": {"insult": 2}, "You are an idiot": {"targeted": 2}, "you. An idiot": {"insult": 2}, "IDIOT, SCUM": {"insult": 5},
    "you are not an idiot": {"negated": 2}, "he said the idiot left": {"reported": 2}, 'the "idiot" of': {"reported": 2},
    "he said no. Idiot": {"insult": 2}, "I will kill you": {"threat": toxicity.SEED_WEIGHT}, "kill the lights": {},
    "never kill you": {}, "she wrote: kill them": {"threat": toxicity.SEED_WEIGHT}, "she wrote kill them": {}, "the loweien": {"insult": 4},
    "a b c d": {}, "": {}, "you x x x x x idiot": {"insult": 2}, "not x x x x scum": {"insult": 3},
}


@pytest.mark.parametrize("text", list(CASES))
def test_patterns(model, text):
    assert dict(zip(toxicity.PATTERNS, model.features(text))) == {p: float(CASES[text].get(p, 0)) for p in toxicity.PATTERNS}


def test_composition_equals_the_steps_one_by_one():
    rng = np.random.default_rng(0)
    table = toxicity.grammar()
    for _ in range(500):
        word = [str(x) for x in rng.choice(list("OITYNRQ"), 12)]
        state, outs, since = 0, [], {"N": 99, "Y": 99, "T": 99}
        said = quoted = False
        for symbol in word:
            state, out = table[state][symbol]
            outs.append(out)
            want, marked = "", (said or quoted, since["N"] < 3, since["Y"] < 4)
            if symbol == "I":
                want = "reported" if marked[0] else "negated" if marked[1] else "targeted" if marked[2] else "insult"
            elif symbol == "Y" and since["T"] < 3:
                want = "threat"
            assert out == want, word
            since = {k: v + 1 for k, v in since.items()}
            if symbol == "T" and not marked[0] and not marked[1]:
                since["T"] = 0
            if symbol == "Y":
                since["T"] = 99 if want else since["T"]
            if symbol in "NY":
                since[symbol] = 0
            said |= symbol == "R"
            quoted ^= symbol == "Q"


def test_learning(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    rows = []
    for i in range(400):
        text = [str(x) for x in rng.choice(words, 40)]
        if i % 8 == 0:
            text[5], text[20] = "zlorp", "quimbly" if i % 16 else "quimbled"
        rows.append((i, " ".join(text), int(i % 8 == 0), "x"))
    rows += [(1000 + i, "copied copied words of one very special rareword", 1, "x") for i in range(50)]
    rows += [(None, "no id", 0, None), (2000, None, 1, None), (2001, "no label", None, None), (2002, "", 0, None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string"))
    assert {"zlorp", "quim*"} <= set(model.insults) and "rareword" not in model.insults
    probe = spark.createDataFrame([(0, "you zlorp and quimblish zlorp"), (1, rows[1][1]), (2, None), (3, ""), (4, "zlorp " * 30_000)], "doc_id long, text string")
    got = [r[0] for r in probe.orderBy("doc_id").select(toxicity.score(F.col("text"), model)).collect()]
    assert got[0] > 0.5 and got[4] > 0.5 and got[1] == got[2] == got[3] < 0.5


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit(empty)
    assert "idiot" in model.insults
    assert empty.select(toxicity.score(F.col("text"), model)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = queries.op1_toxicity(spark, FOLDER).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.02 * len(got)
