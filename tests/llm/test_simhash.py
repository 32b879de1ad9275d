"""Fingerprints against a plain reckoning, and components against all pairs."""

import numpy as np
import pytest
import xxhash

from tidewatch.llm import simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def by_pairs(codes):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= simhash.DISTANCE:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(codes))]


def noisy(rng, n, groups):
    """Random codes, some of them a few bits away from one of the groups' centres."""
    codes = rng.integers(0, 2**64, n, dtype=np.uint64)
    centres = rng.integers(0, 2**64, groups, dtype=np.uint64)
    for i in range(0, n, 2):
        code = int(centres[rng.integers(groups)])
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            code ^= 1 << int(bit)
        codes[i] = code
    return codes


TEXTS = [None, "", "  \n\t", "one", "One two", "a b c", "A B C", "a b c d a b c d", "é è ç É", "x y z w", "to " * 5000]


def test_fingerprint(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r[0]: r[1] for r in simhash.near_duplicates(rows).select("doc_id", "fingerprint").collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(TEXTS)}


def components_of(spark, codes):
    signed = [int(c) - (1 << 64) if int(c) >> 63 else int(c) for c in codes]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    return [r[0] for r in simhash.label(rows).orderBy("doc_id").select("component_id").collect()]


@pytest.mark.parametrize("groups", [1, 12])
def test_components(spark, groups):
    codes = [int(c) for c in noisy(np.random.default_rng(groups), 700, groups)]
    codes += codes[:50]
    assert components_of(spark, codes) == by_pairs(codes)


def test_crowded_node_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    codes = [int(c) for c in noisy(np.random.default_rng(5), 400, 2)]
    assert components_of(spark, codes) == by_pairs(codes)


def test_index_within_a_node():
    rng = np.random.default_rng(3)
    codes = np.sort(noisy(rng, 900, 3))
    assert simhash.linked(codes).tolist() == by_pairs([int(c) for c in codes])


def test_odd_rows(spark):
    shape = "doc_id long, text string, fp string, mark int, component_id int, _twin int"
    rows = [(None, "a b c d", "x", 1, 1, 1), (7, "a b c d", "y", 2, 2, 2), (7, "a b c d", "y", 2, 2, 2),
            (None, None, None, None, None, None), (None, "only here and nowhere else", None, None, None, None), (None, "", "z", 3, 3, 3), (9, "q r s t u", "w", 4, 4, 4)]
    df = spark.createDataFrame(rows, shape)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 7, False, 7)] * 2 + [(False, 9, False, 9)] + [(True, 0, False, 7)] + [(True, 0, True, 0)] * 3
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 7), (False, 9), (True, 0), (True, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
