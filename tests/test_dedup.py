import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import minhash, text
from tidewatch.operators import dedup

P = minhash.PRIME


def py_signature(body):
    import re

    tokens = re.findall(r"\w+", body.lower())
    grams = {" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)} if len(tokens) >= 3 else {" ".join(tokens)}
    hs = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % P for g in grams]
    return [min((a * h + b) % P for h in hs) for a, b in minhash.coefficients()]


def similarity(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def greedy(signatures, threshold=0.85):
    kept = []
    for i, sig in signatures:
        if not any(similarity(sig, k) >= threshold for _, k in kept):
            kept.append((i, sig))
    return {i for i, _ in kept}


def corpus(seed, n, bases=6, words=60):
    rng = random.Random(seed)
    roots = [[f"w{rng.randrange(400)}" for _ in range(words)] for _ in range(bases)]
    out = []
    for i in range(n):
        body = list(rng.choice(roots))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            body[rng.randrange(words)] = f"x{rng.randrange(1000)}"
        out.append((i, " ".join(body)))
    return out


def signed(spark, rows):
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    return df.withColumn("minhash_signature", minhash.signature("content"))


def test_signature_matches_definition(spark):
    rows = [(0, ""), (1, "one"), (2, "Éa ß two three"), (3, " ".join(f"t{i}" for i in range(5000))), (4, None)]
    got = {r["id"]: r["minhash_signature"] for r in signed(spark, rows).collect()}
    for i, body in rows:
        assert got[i] == py_signature(body or "")


def test_jaccard_of_unequal_lengths_is_zero(spark):
    df = spark.sql("select array(1,2,3) a, array(1,2) b, array(1,2,4) c")
    row = df.select(minhash.jaccard_est(F.col("a"), F.col("b")).alias("x"), minhash.jaccard_est(F.col("a"), F.col("c")).alias("y")).first()
    assert row.x == 0.0 and row.y == pytest.approx(2 / 3)


def test_bands_cannot_miss_a_pair(spark):
    rng = random.Random(5)
    need = minhash.needed_matches(0.85)
    rows = []
    for i in range(200):
        a = [rng.randrange(1 << 30) for _ in range(128)]
        b = list(a)
        for j in rng.sample(range(128), 128 - need):  # as different as the threshold allows
            b[j] += 1
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id long, a array<int>, b array<int>")
    both = df.select(minhash.band_hashes(F.col("a"), 0.85).alias("x"), minhash.band_hashes(F.col("b"), 0.85).alias("y"))
    shared = both.select(F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e)).alias("n"))
    assert shared.agg(F.min("n")).first()[0] >= 2


@pytest.mark.parametrize("seed,bucket,plain", [(1, 200, 2), (2, 3, 0), (3, 3, 2), (4, 1, 1)])
def test_greedy_equals_sequential(spark, monkeypatch, seed, bucket, plain):
    monkeypatch.setattr(dedup, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(dedup, "LEADER_ROUNDS", plain)
    monkeypatch.setattr(dedup, "BLOCK", 7)
    rows = corpus(seed, 150)
    expected = greedy([(i, py_signature(b)) for i, b in rows])
    verdicts = dedup.greedy_verdicts(signed(spark, rows), []).collect()
    assert len(verdicts) == len(rows)
    assert {r["id"] for r in verdicts if r["kept"]} == expected
    sigs = {i: py_signature(b) for i, b in rows}
    for r in verdicts:
        if not r["kept"]:
            first = r["copy_of"]
            assert first < r["id"]
            # a copy of a copy names the first arrival of its signature or a kept item
            assert similarity(sigs[first], sigs[r["id"]]) >= 0.85


def test_chain_keeps_both_ends(spark):
    """A~B and B~C but not A~C: B falls, C stays."""
    base = [f"w{i}" for i in range(200)]
    a, b, c = list(base), list(base), list(base)
    for i in (20, 60, 100):
        b[i] = c[i] = f"b{i}"
    for i in (140, 180, 190):
        c[i] = f"c{i}"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    s = [py_signature(x) for _, x in rows]
    assert similarity(s[0], s[1]) >= 0.85 and similarity(s[1], s[2]) >= 0.85 and similarity(s[0], s[2]) < 0.85
    kept = dedup.greedy_verdicts(signed(spark, rows), []).filter("kept")
    assert {r["id"] for r in kept.collect()} == {1, 3}


def test_a_third_of_all_rows_are_copies(spark):
    rows = corpus(9, 200) + [(1000 + i, "one text that everybody copies word for word today") for i in range(100)]
    verdicts = dedup.greedy_verdicts(signed(spark, rows), [])
    assert verdicts.filter("id >= 1000 and kept").count() == 1
    assert {r["id"] for r in verdicts.filter("kept").collect()} == greedy([(i, py_signature(b)) for i, b in rows])


@pytest.mark.parametrize("bucket", [200, 2])
def test_near_duplicates_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(dedup, "PAIR_BUCKET", bucket)
    rows = corpus(11, 120)
    old, new = rows[:40], rows[40:]
    sigs = {i: py_signature(b) for i, b in rows}
    expected = {i for i, _ in new if any(similarity(sigs[i], sigs[j]) >= 0.85 for j, _ in old)}
    got = dedup.near_duplicates(signed(spark, new), signed(spark, old))
    assert {r["id"] for r in got.collect()} == expected and 0 < len(expected) < len(new)


@pytest.mark.parametrize("n", [60, 240])
def test_templated_texts_need_no_more_rounds(spark, monkeypatch, n):
    """Texts alike enough to share buckets but not to be duplicates: the rounds don't grow with their number."""
    monkeypatch.setattr(dedup, "PAIR_BUCKET", 10)
    rng = random.Random(3)
    frame = [f"form{i}" for i in range(60)]
    rows = []
    for i in range(n):
        body = list(frame)
        for j in rng.sample(range(60), 4):
            body[j] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(body)))
    written = []
    real = dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df: written.append(1) or real(df))
    kept = {r["id"] for r in dedup.greedy_verdicts(signed(spark, rows), []).filter("kept").collect()}
    assert kept == greedy([(i, py_signature(b)) for i, b in rows])
    assert len(written) <= 40


def test_long_chain_is_settled_in_bounded_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 3), (500, 4), (700, 699)], "later long, earlier long")
    written = []
    real = dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df: written.append(1) or real(df))
    got = {r["rank"]: r["copy_of"] for r in dedup._settle(edges).collect()}
    assert got == {i: i - 1 for i in range(1, 201, 2)} | {500: 4, 700: 699}
    assert len(written) <= 2 * dedup.SETTLE_ROUNDS + 2


def test_semi_join_of_crowded_buckets_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SALT_PAIRS", 20)
    rows = corpus(12, 120, bases=1)
    old, new = rows[:40], rows[40:]
    sigs = {i: py_signature(b) for i, b in rows}
    expected = {i for i, _ in new if any(similarity(sigs[i], sigs[j]) >= 0.85 for j, _ in old)}
    assert {r["id"] for r in dedup.near_duplicates(signed(spark, new), signed(spark, old)).collect()} == expected


def test_known_urls_and_first_seen(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, "c")], "id long, url string")
    stored = spark.createDataFrame([("b",), ("b",)], "url string")
    got = dedup.drop_known_urls(batch, stored, ["id"])
    assert sorted(r["id"] for r in got.collect()) == [1, 6]


def templated(spark, n, own, seed=3):
    """Signatures that agree with one template in all but `own` random places each."""
    rng = random.Random(seed)
    base = [rng.randrange(1 << 30) for _ in range(128)]
    rows = []
    for i in range(n):
        sig = list(base)
        for j in rng.sample(range(128), own):
            sig[j] = rng.randrange(1 << 30)
        rows.append((i, sig))
    return rows, spark.createDataFrame(rows, "id long, minhash_signature array<long>").repartition(4)


@pytest.mark.parametrize("n", [400, 1600])
def test_template_below_the_threshold_lists_no_pairs(spark, monkeypatch, n):
    """All items share crowded buckets; candidates grow with the items, not with their pairs."""
    monkeypatch.setattr(dedup, "PAIR_BUCKET", 30)
    seen = []
    verified = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    monkeypatch.setattr(dedup, "_crowded_pairs", lambda *a: pytest.fail("compared block by block"))
    _, items = templated(spark, n, 24)
    assert dedup.greedy_verdicts(items, []).filter("kept").count() == n
    assert sum(seen) <= 60 * n


@pytest.mark.parametrize("own", [6, 10, 14, 19])
def test_rare_places_lose_no_pair(spark, monkeypatch, own):
    monkeypatch.setattr(dedup, "PAIR_BUCKET", 5)
    monkeypatch.setattr(dedup, "LEADER_ROUNDS", 0)
    rows, items = templated(spark, 120, own)
    got = {r["id"] for r in dedup.greedy_verdicts(items, []).filter("kept").collect()}
    assert got == greedy(rows)


def test_a_long_chain_is_walked(spark, monkeypatch):
    """Each item resembles the one before only: every second one stays, after any number of rounds."""
    monkeypatch.setattr(dedup, "SETTLE_ROUNDS", 1)
    n = 20_000
    edges = spark.range(1, n).select(F.struct(F.col("id").alias("item")).alias("later"), F.struct((F.col("id") - 1).alias("item")).alias("earlier"))
    dropped = dedup._settle(edges)
    assert dropped.count() == n // 2 and dropped.filter("rank.item % 2 = 0 or copy_of.item <> rank.item - 1").isEmpty()


def test_buckets_keep_no_hashes(spark, monkeypatch):
    """Rows of buckets carry their item and key alone."""
    shapes = []
    real = dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df: shapes.append(df.columns) or real(df))
    dedup.greedy_verdicts(signed(spark, corpus(2, 30)), []).collect()
    assert ["rank", "key"] in shapes or ["key", "rank"] in shapes
    assert not any("hashes" in s for s in shapes)


def test_rare_places_leave_tasks_as_keys_only(spark):
    """What a crowded table shuffles to find rare places is counters and 20 numbers a signature, not all of its places."""
    _, items = templated(spark, 300, 24)
    keys = dedup._rare_keys(items.selectExpr("id rank", "minhash_signature sig"), 109, 128)
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").replace("Exchange RoundRobin", "")
    assert keys.groupBy("rank").count().filter("count > 20").isEmpty()


def test_sketches_never_tell_too_few_matches(spark):
    """pairs are dropped by the sketches, so these must not miss one; for long signatures they say nothing."""
    rng = random.Random(8)
    rows = [([rng.randrange(1 << 31) for _ in range(n)], [rng.randrange(1 << 31) for _ in range(m)]) for n, m in ((128, 128), (128, 90), (70, 128)) for _ in range(20)]
    rows += [(a, [x if rng.random() < 0.9 else y for x, y in zip(a, b)]) for a, b in rows[:20]] + [(rows[0][0], rows[0][0]), ([], []), ([1] * 129, [1] * 129), (None, [1])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1)
    sketched = df.select("a", "b", minhash.sketch(F.col("a")).alias("x"), minhash.sketch(F.col("b")).alias("y"))
    got = sketched.select(minhash.matches(F.col("a"), F.col("b")).alias("n"), minhash.most_matches(F.col("x"), F.col("y")).alias("most"))
    found = [(r.n, r.most) for r in got.collect()]
    assert all(n <= most for n, most in found[:-2]) and found[-4][1] == 128 and found[-2][1] is None and found[-1][1] is None
    assert all(most < 109 for _, most in found[:20]) and sum(n >= 100 for n, _ in found[60:80]) >= 15


def test_unlike_items_of_a_bucket_are_not_listed(spark, monkeypatch):
    """of the pairs of a small bucket only those leave it that may reach the threshold."""
    seen = []
    verified = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    rng = random.Random(4)
    base = [rng.randrange(1 << 30) for _ in range(128)]
    edges = [round(i * 128 / 21) for i in range(22)]
    rows = [(i, [base[j] if edges[band] <= j < edges[band + 1] else rng.randrange(1 << 30) for j in range(128)]) for i, band in enumerate([3] * 12 + [9] * 12)]
    rows.append((99, [x if j < 110 else x + 1 for j, x in enumerate(rows[0][1])]))
    items = spark.createDataFrame(rows, "id long, minhash_signature array<int>")
    kept = {r["id"] for r in dedup.greedy_verdicts(items, []).filter("kept").collect()}
    assert kept == {i for i, _ in rows} - {99} and sum(seen) == 1
