"""The stages one by one and together."""

import os

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import queries, similar

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    docs = start = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == start.columns, name
        assert docs.subtract(start).isEmpty(), name
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    known = Tokenizer.from_file(queries.vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(out) == sizes[4]
    for r in out:
        assert list(r.ids) == known.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_one_of_each_group_stays(spark):
    """Against all pairs of texts of the same shingle counts, at a similarity of 0.8."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect())
    rows = sorted((r.doc_id, set(similar.shingles_of(r.text).tolist())) for r in docs.select("doc_id", "text").collect())
    group = {doc_id: doc_id for doc_id, _ in rows}
    for i, (x, one) in enumerate(rows):
        for y, two in rows[:i]:
            if group[x] != group[y] and (one == two or len(one & two) >= 0.8 * len(one | two) - 1e-9):
                low, high = sorted((group[x], group[y]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert len(set(group.values())) < len(rows) and kept == sorted(set(group.values()))


def test_odd_documents(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    text = "a plain sentence about nothing in particular that goes on for a while and then stops"
    rows = [(None, text, None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, "en", "s", 0), (3, "", None, "s", 0),
            (4, "1 2 3", "en", None, 5), (5, " ".join(f"{text} {i}" for i in range(2000)), "en", "t", 9)]
    docs = spark.createDataFrame(rows, shape)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], shape), FOLDER).count() == 0
        docs = stage(spark, docs, FOLDER).cache()
    assert {r.doc_id for r in docs.collect()} <= {1, 5}


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()} and "pipeline" in entry.queries()
