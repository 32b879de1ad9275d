"""Held-out accuracy, mixtures and odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = queries.op7_language(spark, FOLDER).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


EN, DE = "the house and the river with that other thing they were looking for ", "der hund und die katze nicht auf dem dach mit einer schönen straße "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, [EN, DE][i % 2] * 5, ["en", "de"][i % 2], "x") for i in range(40)] + [(50, None, "en", "x"), (51, "text", None, "x"), (None, EN, "en", "x")]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket string"))


def test_odd_rows(spark, model):
    texts = [None, "", "  ", "123 !! 456", EN, DE, DE * 3000, EN * 6 + DE * 2, "日本語"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(language.identify(F.col("text"), model)).collect()]
    assert [g.lang_pred for g in got[:8]] == ["und"] * 4 + ["en", "de", "de", "en"]
    assert all(g.score == 0 and not g.languages for g in got[:4])
    assert got[7].languages == ["en", "de"] and got[7].shares[0] == pytest.approx(0.75, abs=0.06)
    assert got[4].languages == ["en"] and got[6].shares == [1.0]


def test_keep_identified(spark, model):
    df = spark.createDataFrame([(1, EN, "a"), (1, EN, "a"), (2, None, None), (None, DE, "b"), (3, "1 2 3", "c")], "doc_id long, text string, lang_pred string")
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.where("lang_pred in ('a', 'b')").collect()))


def test_no_labels(spark):
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, EN)], "doc_id long, text string")
    assert df.select(language.identify(F.col("text"), empty)).first()[0].lang_pred == "und"
    assert df.where("false").select(language.identify(F.col("text"), empty)).count() == 0


def test_rare_language_is_not_lost_in_the_sample(spark):
    rows = [(i, "the river and the stone of the wind", "en") for i in range(2000)] + [(9000 + i, "wąż żółty chrząszcz brzmi", "pl") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=60)
    assert model.languages == ("en", "pl")


def test_clashing_columns_stay(spark):
    rows = [(1, "the river and the stone", "en", "mine", 5), (2, "12 34", "en", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, identified string, lang_pred long")
    kept = language.keep_identified(docs, language.fit(docs))
    assert kept.dtypes == docs.dtypes and [tuple(r) for r in kept.collect()] == rows[:1]
    assert language.keep_identified(docs.limit(0), language.fit(docs)).count() == 0
