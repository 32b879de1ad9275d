"""Language identification as a mixture of languages per document.

Every language is a distribution of hashed character trigrams.  A text is cut
into windows of trigrams; expectation-maximisation finds the proportions of
languages that make the windows likeliest, and the set of languages is the one
of the highest likelihood after a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DIGESTS, fresh

#: Buckets of trigrams, trigrams per window, and EM rounds.
BUCKETS, WINDOW, ROUNDS = 1 << 14, 32, 25
#: The model is fitted on about this many labelled rows, chosen by a digest of the row's doc_id.
SAMPLE_ROWS = 20_000
UNKNOWN = "und"
SHAPE = "lang_pred string, score double, languages array<string>, shares array<double>"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # languages x buckets, natural logarithms


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams around each letter of a lower-cased text; other characters count as one."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    padded = np.zeros(len(points) + 2, np.uint64)
    padded[1:-1] = points
    mixed = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points * np.uint64(0xC2B2AE3D27D4EB4F) ^ padded[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50))[points > 0].astype(np.int64) & (BUCKETS - 1)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages of (doc_id, text, lang); rows without a text or a lang are no evidence.

    It is fitted on about `sample_rows` rows, equally many of each language as
    far as there are, chosen by a digest of the doc_id.
    Counts are summed in Spark; the driver gets one number per language and
    bucket.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    totals = dict(rows.groupBy("lang").count().collect())
    if sum(totals.values()) > sample_rows:
        share = [F.lit(x) for lang, n in totals.items() for x in (lang, min(DIGESTS, DIGESTS * sample_rows // (n * len(totals))))]
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(DIGESTS)) < F.element_at(F.create_map(*share), F.col("lang")).cast("long"))
    sums = rows.mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["lang"].unique()))
    table = np.zeros((len(languages), BUCKETS))
    table[sums["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"]
    table += 0.5
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _mixture(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document; units: languages x windows, in document order."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    top = units.max(axis=0)
    scaled = np.exp(units - top)
    shares = np.full((len(units), len(sizes)), 1 / len(units))
    for _ in range(ROUNDS):
        parts = shares[:, which] * scaled
        parts /= np.maximum(parts.sum(axis=0), 1e-300)
        shares = np.add.reduceat(parts, starts, axis=1) / sizes
    level = np.log(np.maximum((shares[:, which] * scaled).sum(axis=0), 1e-300)) + top
    return shares, np.add.reduceat(level, starts)


def _select(units: np.ndarray, grams: int) -> tuple[list[int], np.ndarray]:
    """Languages of one document and their proportions: drop the smallest while the penalised likelihood does not fall."""
    chosen = list(range(len(units)))

    def value(of: list[int]) -> tuple[float, np.ndarray]:
        shares, level = _mixture(units[of], np.array([0]), np.array([units.shape[1]]))
        return level[0] - 0.5 * (len(of) - 1) * np.log(grams), shares[:, 0]

    best, shares = value(chosen)
    while len(chosen) > 1:
        fewer = [x for i, x in enumerate(chosen) if i != int(np.argmin(shares))]
        level, other = value(fewer)
        if level < best:
            break
        chosen, best, shares = fewer, level, other
    return chosen, shares


def _predict(model: Model, texts: list[str | None]) -> list[tuple]:
    found: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(texts)
    rows, units, grams = [], [], []
    for i, text in enumerate(texts):
        at = trigrams(text)
        if len(at) and model.languages:
            units.append(np.add.reduceat(model.logs[:, at], np.arange(0, len(at), WINDOW), axis=1, dtype=np.float64))
            rows.append(i)
            grams.append(len(at))
    if not rows:
        return found
    sizes = np.array([u.shape[1] for u in units])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    everything = np.concatenate(units, axis=1)
    alone = np.add.reduceat(everything, starts, axis=1)
    _, level = _mixture(everything, starts, sizes)
    best = alone.argmax(axis=0)
    mixed = level - 0.5 * np.log(grams) > alone.max(axis=0)  # else no set of two or more can win
    surest = 1 / np.exp(alone - alone.max(axis=0)).sum(axis=0)
    for k, i in enumerate(rows):
        if mixed[k]:
            chosen, shares = _select(units[k], grams[k])
            order = sorted(range(len(chosen)), key=lambda j: (-shares[j], chosen[j]))
            names = [model.languages[chosen[j]] for j in order]
            found[i] = (names[0], float(min(1.0, shares[order[0]])), names, [float(shares[j]) for j in order])
        else:
            found[i] = (model.languages[best[k]], float(surest[k]), [model.languages[best[k]]], [1.0])
    return found


def identify(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score, languages and their shares, the largest first.

    `und`, with score 0 and no language, if the text is NULL, has no letter, or
    the model knows no language.  The score is the proportion of the predicted
    language, or with a single language the probability that it is that one.
    Ties go to the first language by name.  The whole text counts.
    """

    @F.pandas_udf(SHAPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [x for i in range(0, len(texts), 500) for x in _predict(model, texts[i:i + 500].tolist())]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages", "shares"])

    return run(text)


def keep_identified(docs: DataFrame, model: Model, least_share: float = 0.5) -> DataFrame:
    """The rows whose language is known and makes up at least `least_share` of the text, with all their columns.

    Texts without letters go, and so do texts that no language dominates; a
    short text of one language stays however unsure its name is.
    """
    (own,) = fresh(docs, "identified")
    kept = docs.withColumn(own, identify(F.col("text"), model)).where(
        (F.col(f"{own}.lang_pred") != UNKNOWN) & (F.get(F.col(f"{own}.shares"), F.lit(0)) >= least_share))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
