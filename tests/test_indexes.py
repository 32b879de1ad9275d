"""What is kept beside the store: URL filters, keyword postings, band hashes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import minhash
from tidewatch.operators import dedup, maintenance
from tidewatch.plans import search as sx
from tidewatch.sources import postings, store, url_filter

DAY = dt.datetime(2024, 1, 1)
ARTICLE = "id long, source string, title string, content string, url string, timestamp timestamp, dt date"
WORDS = ["news", "stock", "rally", "crash", "newsroom", "quiet", "of", "Ünion", "stocks"]


def written(spark, path, rows, batch=0):
    articles = spark.createDataFrame(rows, ARTICLE)
    url_filter.forget(spark, path, batch)
    store.write_table(articles, f"{path}/articles", batch)
    url_filter.write(articles, path, batch)
    return articles


def dated(n, day, tag="u"):
    at = DAY + dt.timedelta(days=day)
    return [(day * 100_000 + i, "s", "title", "text", f"{tag}{day}/{i}", at, at.date()) for i in range(n)]


def urls(spark, *names):
    return spark.createDataFrame([(u,) for u in names], "url string")


def test_filter_reads_the_right_dates_only(spark, tmp_path):
    path = str(tmp_path / "s")
    written(spark, path, [r for day in range(6) for r in dated(300, day)])
    written(spark, path, dated(9000, 7), batch=1)                      # several bitmaps
    assert url_filter.dates_to_read(urls(spark, "u2/17", "u7/8999", "nowhere", None), path) == ["2024-01-03", "2024-01-08"]
    assert url_filter.dates_to_read(urls(spark, "nowhere", ""), path) == []
    every = urls(spark, *[r[4] for day in range(6) for r in dated(300, day)], *[r[4] for r in dated(9000, 7)])
    met = url_filter.possible(every, spark.read.parquet(f"{path}/url_filters"))
    assert met.select("url").distinct().count() == 10_800 and met.count() < 10_800 * 1.01
    stored = spark.read.schema(ARTICLE + ", batch long").parquet(f"{path}/articles")
    batch = urls(spark, "u2/17", "fresh", "fresh").withColumn("id", F.monotonically_increasing_id())
    near = url_filter.narrowed(stored, batch, path)
    assert {f.split("dt=")[1][:10] for f in near.inputFiles()} >= {"2024-01-03"}
    assert {r.dt.isoformat() for r in near.select("dt").distinct().collect()} == {"2024-01-03"}
    assert [r.url for r in dedup.drop_known_urls(batch, near, ["id"]).collect()] == ["fresh"]


def test_dates_without_a_filter_are_read(spark, tmp_path):
    path = str(tmp_path / "s")
    written(spark, path, dated(5, 0) + [(1, "s", "t", "c", None, DAY, DAY.date()), (2, "s", "t", "c", "undated", None, None)])
    old = spark.createDataFrame(dated(5, 3), ARTICLE)
    store.write_table(old, f"{path}/articles", 4)                      # written before there were filters
    assert url_filter.dates_to_read(urls(spark, "x"), path) == ["2024-01-04"]
    stored = spark.read.schema(ARTICLE + ", batch long").parquet(f"{path}/articles")
    assert {r.url for r in url_filter.narrowed(stored, urls(spark, "x"), path).collect()} == {r[4] for r in dated(5, 3)} | {"undated"}
    url_filter.forget(spark, path, 0)                                  # a replay that ended before its filters came back
    assert url_filter.dates_to_read(urls(spark, "x"), path) == ["2024-01-01", "2024-01-04"]
    assert url_filter.dates_to_read(urls(spark, "x"), str(tmp_path / "none")) == []


def test_filters_and_postings_expire_with_the_articles(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [r for day in (0, 9, 10) for r in dated(3, day)]
    postings.write(written(spark, path, rows), path, 0)
    maintenance.expire_store(spark, path, DAY + dt.timedelta(days=12), 5)
    assert url_filter.dates_to_read(urls(spark, *[r[4] for r in rows]), path) == ["2024-01-10", "2024-01-11"]
    assert {r.dt.isoformat() for r in spark.read.parquet(f"{path}/postings").select("dt").distinct().collect()} == {"2024-01-10", "2024-01-11"}


def by_query(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.query_id, set()).add((row.id, row.title, row.url))
    return out


@pytest.mark.parametrize("addresses", [10_000, 40, 6])
def test_postings_equal_the_search_in_texts(spark, tmp_path, addresses):
    """Ties in time, shared and missing URLs, missing texts and times, two batches."""
    rng, path = random.Random(addresses), str(tmp_path / "s")
    rows = []
    for i in range(160):
        at = DAY + dt.timedelta(hours=rng.randrange(12 * 24) // 3 * 3) if i % 50 else None
        url = None if i % 40 == 3 else f"{i % 2}/{i if addresses > 1000 else rng.randrange(addresses)}"
        rows.append((i, "s", rng.choice([None, "", " ".join(rng.choices(WORDS, k=2))]), rng.choice([None, f"{rng.choice(WORDS)}\nNews x{i}"]),
                     url, at, at and at.date()))
    for batch in (0, 1):   # a URL stays within one batch; those without come in the second only
        part = [r for r in rows if (r[4] or "1").startswith(str(batch))]
        df = spark.createDataFrame(part, ARTICLE)
        store.write_table(df, f"{path}/articles", batch)
        for _ in range(2):
            postings.write(df, path, batch)
    articles = spark.createDataFrame(rows, ARTICLE)
    texts = ["news", "ÜNION", "of", "", None, "x17 x3", "nothing", "quiet crash", "news stock rally crash quiet"]
    log = spark.createDataFrame([(str(q), q) for q in texts], "query_id string, raw_query string")
    want = by_query(sx.keyword_search_batch(log, articles, 4))
    assert by_query(postings.search(spark, log, path, k=4)) == want
    single = {q: {(r.id, r.title, r.url) for r in sx.keyword_search(articles, q, 4).collect()} for q in texts if q}
    assert want == {q: rows for q, rows in single.items() if rows}


def test_a_common_word_reads_its_newest_dates(spark, tmp_path):
    """The vocabulary says which dates are enough: a hot word stops early, a rare one goes as far as it occurs."""
    path, rows = str(tmp_path / "s"), []
    for day in range(30):
        at = DAY + dt.timedelta(days=day)
        rows += [(day * 100 + i, "s", "daily news", "rare" if day in (3, 20) and i == 0 else "", f"{day}/{i}", at, at.date()) for i in range(8)]
    postings.write(spark.createDataFrame(rows, ARTICLE), path, 0)
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    hot = postings.needed(spark.createDataFrame([("news",)], "word string"), vocabulary, 10)
    assert hot.dates == ["2024-01-29", "2024-01-30"]
    both = postings.needed(spark.createDataFrame([("news",), ("rare",)], "word string"), vocabulary, 10)
    assert both.dates == ["2024-01-04", "2024-01-21", "2024-01-29", "2024-01-30"]
    assert both.alone.filter("word = 'news'").count() == 2
    # many queries of a hot word: each word brings no more than k articles
    written(spark, path, rows)
    log = spark.range(500).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("news").alias("raw_query"))
    got = by_query(postings.search(spark, log, path))
    newest = {(r[0], r[2], r[4]) for r in sorted(rows, key=lambda r: (r[5], r[0]))[-10:]}
    assert len(got) == 500 and all(v == newest for v in got.values())


def test_empty_store(spark, tmp_path):
    log = spark.createDataFrame([("q", "news")], "query_id string, raw_query string")
    assert postings.search(spark, log, str(tmp_path / "none")).count() == 0


def test_kept_bands_give_the_same_copies(spark):
    rng = random.Random(4)
    base = [[rng.randrange(1 << 30) for _ in range(128)] for _ in range(4)]
    rows = []
    for i in range(80):
        sig = list(rng.choice(base))
        for j in rng.sample(range(128), rng.choice([0, 5, 19, 20, 40])):
            sig[j] = rng.randrange(1 << 30)
        rows.append((i, sig))
    df = spark.createDataFrame(rows, "id long, minhash_signature array<int>").withColumn("bands", minhash.band_hashes(F.col("minhash_signature"), 0.85))
    bare = F.when(F.col("id") % 3 > 0, F.col("bands")).alias("bands")  # an older store has some without
    old, new = df.filter("id < 40").select("id", "minhash_signature", bare), df.filter("id >= 40")
    want = {r.id for r in dedup.near_duplicates(new, old).collect()}
    assert {r.id for r in dedup.near_duplicates(new, old, bands_col="bands").collect()} == want and want
