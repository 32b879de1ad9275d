"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word of a text from the two words on either side
of it; a text's score is the sum of those conditional log-probabilities.  The
network gives the probability of the word's class: frequent words are classes of
their own, other words share one by their ending.  The probability of the word
within its class comes from counts of all words of the whole corpus, with a
share for words that were never seen.  The training runs in rounds, which mask
every position of every document: each partition trains on its own examples from
the common weights, and Spark averages the results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable

#: Classes of frequent words and of other words' endings, context words on each side, and hidden units.
FREQUENT, ENDINGS, REACH, HIDDEN = 192, 64, 2, 24
CLASSES = FREQUENT + ENDINGS
#: Classes are predicted in two steps, a cluster and a member of it.
CLUSTERS = MEMBERS = 16
#: Slots in which the words of an ending are counted, by a checksum; words of one slot share their probability.
SLOTS = 16_384
EDGE = CLASSES  # stands for what is before and after a text
#: One position in so many is masked in a round, so as many rounds mask all (15 at most); least number of rounds; examples of a task's first
#: steps and of its later ones, which are twice as many every RAMP steps; step size.
MASKED, ROUNDS, STEP_ROWS, MOST_ROWS, RAMP, RATE = 8, 3, 256, 4096, 8, 0.01
#: Words in a stored block, positions scored at a time, words whose code a task remembers, and tasks that train.
BLOCK, CHUNK, MEMO, TASKS = 65_536, 8192, 400_000, 4096
#: Averaged weights are summed as whole numbers of this part of one, so their order doesn't matter.
UNIT = 1 << 16


def slot_of(word: bytes) -> int:
    """Ending and slot of a lower-cased word, as one number."""
    ending = (word[-1] * 7 + (word[-2] if len(word) > 1 else 0) * 31) % ENDINGS
    return ending * SLOTS + zlib.crc32(word) % SLOTS


class Codes(dict):
    """The code of a lower-cased word: its class if it is frequent, else FREQUENT and its slot_of()."""

    def __missing__(self, word: bytes) -> int:
        code = FREQUENT + slot_of(word)
        if len(self) < MEMO:
            self[word] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def classes_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < FREQUENT, codes, FREQUENT + (codes - FREQUENT) // SLOTS).astype(np.int16)


@dataclass(frozen=True)
class Model:
    frequent: dict[bytes, int]
    within: np.ndarray  # ln P(word | class) by code
    weights: np.ndarray


def windows(classes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For positions (every one by default) the classes of their context, left to right, and their own in the last column."""
    padded = np.pad(classes, REACH, constant_values=EDGE)
    at = np.arange(len(classes)) if at is None else at
    places = [i for i in range(2 * REACH + 1) if i != REACH] + [REACH]
    return padded[at[:, None] + np.array(places)]


def _shapes() -> list[tuple[int, ...]]:
    return [(2 * REACH, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLUSTERS), (CLUSTERS,), (CLUSTERS, HIDDEN, MEMBERS), (CLUSTERS, MEMBERS)]


def _split(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes():
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def _hidden(rows: np.ndarray, inward: np.ndarray, bias: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.intp)
    total = inward[0].take(rows[:, 0], axis=0)
    total += bias
    for place in range(1, 2 * REACH):
        total += inward[place].take(rows[:, place], axis=0)
    return np.tanh(total, out=total)


def _softmax(hidden: np.ndarray, outward: np.ndarray, level: np.ndarray, wide: bool) -> np.ndarray:
    """Probabilities of each row's classes; `wide` if their logits may leave the range of single precision."""
    logits = hidden @ outward
    logits += level
    if wide:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones((logits.shape[1], 1), logits.dtype))
    return logits


def _wide(upper: np.ndarray, upper_level: np.ndarray, lower: np.ndarray, lower_level: np.ndarray) -> bool:
    """Whether some logit may be beyond 60; hidden values are between -1 and 1."""
    return max(float((np.abs(upper).sum(axis=0) + np.abs(upper_level)).max()), float((np.abs(lower).sum(axis=1) + np.abs(lower_level)).max())) > 60


def _by_class(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by own class, and where each cluster begins and ends in it."""
    order = np.argsort(rows[:, -1], kind="stable")
    return order, np.searchsorted(rows[order, -1], np.arange(CLUSTERS + 1) * MEMBERS)


def log_probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """ln P(own class | context) of each row of windows()."""
    inward, bias, upper, upper_level, lower, lower_level = _split(weights)
    wide = _wide(upper, upper_level, lower, lower_level)
    out = np.empty(len(rows))
    for at in range(0, len(rows), CHUNK):
        part = rows[at:at + CHUNK]
        order, cuts = _by_class(part)
        part = part[order]
        own = part[:, -1]
        hidden = _hidden(part, inward, bias)
        logs = np.log(np.maximum(_softmax(hidden, upper, upper_level, wide)[np.arange(len(part)), own // MEMBERS], 1e-30))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                p = _softmax(hidden[a:b], lower[k], lower_level[k], wide)
                logs[a:b] += np.log(np.maximum(p[np.arange(b - a), own[a:b] % MEMBERS], 1e-30))
        out[at + order] = logs
    return out


def gradient(parts: list[np.ndarray], rows: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the rows, and its gradient by each part of the weights."""
    inward, bias, upper, upper_level, lower, lower_level = parts
    wide = _wide(upper, upper_level, lower, lower_level)
    order, cuts = _by_class(rows)
    rows = rows[order]
    own, at = rows[:, -1], np.arange(len(rows))
    hidden = _hidden(rows, inward, bias)
    p = _softmax(hidden, upper, upper_level, wide)
    loss = -float(np.log(np.maximum(p[at, own // MEMBERS], 1e-30)).sum())
    p[at, own // MEMBERS] -= 1
    back = p @ upper.T
    into_lower, into_level = np.zeros_like(lower), np.zeros_like(lower_level)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            q = _softmax(hidden[a:b], lower[k], lower_level[k], wide)
            mine = own[a:b] % MEMBERS
            loss -= float(np.log(np.maximum(q[at[:b - a], mine], 1e-30)).sum())
            q[at[:b - a], mine] -= 1
            back[a:b] += q @ lower[k].T
            into_lower[k], into_level[k] = hidden[a:b].T @ q, q.sum(axis=0)
    back *= 1 - hidden * hidden
    into = np.zeros_like(inward)
    for place in range(2 * REACH):
        by = np.argsort(rows[:, place], kind="stable")
        there = rows[by, place]
        starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
        into[place][there[starts]] = np.add.reduceat(back.take(by, axis=0), starts)
    slopes = [into, back.sum(axis=0), hidden.T @ p, p.sum(axis=0), into_lower, into_level]
    for slope in slopes:
        slope /= len(rows)
    return loss / len(rows), slopes


def train_on(flat: np.ndarray, blocks: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Adam steps over blocks of examples, and how many examples there were."""
    flat = flat.astype(np.float32).copy()
    parts = _split(flat)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    seen = step = 0
    for rows in blocks:
        rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]
        at = 0
        while at < len(rows):
            size = min(STEP_ROWS << step // RAMP, MOST_ROWS)
            step += 1
            slope = np.concatenate([x.ravel() for x in gradient(parts, rows[at:at + size])[1]])
            at += size
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            flat -= np.float32(RATE / np.sqrt(step / 100 + 1) / (1 - 0.9 ** step)) * first / (np.sqrt(second / np.float32(1 - 0.999 ** step)) + np.float32(1e-8))
        seen += len(rows)
    return flat, seen


def count_words(docs: DataFrame) -> DataFrame:
    """(word, slot, n): every lower-cased word of all texts, counted in each task before the shuffle, with its slot_of()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch["text"]:
                counts.update((text or "").encode("utf-8", "surrogatepass").lower().split())
            words = list(counts)
            yield pd.DataFrame({"word": pd.Series(words, dtype=object), "slot": np.fromiter(map(slot_of, words), np.int32, len(words)),
                                "n": np.fromiter(counts.values(), np.int64, len(words))})

    return docs.select("text").mapInPandas(run, "word binary, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The commonest words and their classes, ties by word, and ln P(word | class) by code.

    All words are counted over the whole corpus; the driver gets FREQUENT words
    and the sum of each slot.  Every slot, seen or not, has one count more than
    it holds, so a class's probabilities add up to one.
    """
    words = durable(count_words(docs))
    top = [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    rest = words.where(~F.col("word").isin(top)) if top else words
    sums = rest.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ENDINGS * SLOTS)
    counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    table = counts.reshape(ENDINGS, SLOTS) + 1
    within = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
    return {w: i for i, w in enumerate(top)}, np.r_[np.zeros(FREQUENT), within].astype(np.float32)


def masked(size: int, start: int, number: int, every: int) -> np.ndarray:
    """Positions of a text of `size` words that round `number` masks; `start` is the text's digest.

    Every round has at least one position, and `every` rounds have all of them.
    """
    stride = min(every, size)
    return np.arange((start + number) % stride, size, stride) if size else np.zeros(0, np.int64)


def phases(size: int, start: int, every: int) -> np.ndarray:
    """When each position of a text is masked: in every round whose number leaves its first part modulo its second, as one number."""
    stride = min(every, size)
    return ((np.arange(size) - start) % stride + stride * 16).astype(np.uint8)


def examples(docs: DataFrame, frequent: dict[bytes, int], every: int) -> DataFrame:
    """(classes, phases): blocks of texts as the int16 classes of their words, REACH edges behind each, and the phases of all positions."""

    def block(held: list[np.ndarray], when: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"classes": [np.concatenate(held).astype("<i2").tobytes()], "phases": [np.concatenate(when).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, when, size = Codes(frequent), [], [], 0
        edge, never = np.full(REACH, EDGE, "<i2"), np.zeros(REACH, np.uint8)
        for batch in batches:
            for text in batch["text"]:
                codes = own.of(text)
                if not len(codes):
                    continue
                held += [classes_of(codes), edge]
                when += [phases(len(codes), zlib.crc32(text.encode("utf-8", "surrogatepass")), every), never]
                size += len(codes)
                if size >= BLOCK:
                    yield block(held, when)
                    held, when, size = [], [], 0
        if size:
            yield block(held, when)

    return docs.select("text").mapInPandas(run, "classes binary, phases binary")


def chosen(classes: bytes, when: bytes, number: int) -> np.ndarray:
    """The windows() of one stored block that round `number` masks."""
    turn = np.array([number % s + s * 16 if s else 1 for s in range(16)], np.uint8)
    when = np.frombuffer(when, np.uint8)
    return windows(np.frombuffer(classes, "<i2"), np.flatnonzero(when == turn[when >> 4]))


def fit(docs: DataFrame, rounds: int | None = None) -> Model:
    """A model of (text, ...); NULL and empty texts give no example, repeated rows count each time, an empty table gives the untrained network.

    By default there are as many rounds as mask every position.  Each costs one
    pass over the classes of all words, which grow with the corpus, and one sum
    per weight over at most TASKS tasks.
    """
    every = MASKED
    frequent, within = vocabulary(docs)
    blocks = durable(examples(docs, frequent, every)).coalesce(TASKS)
    size = sum(int(np.prod(s)) for s in _shapes())
    flat = (np.random.default_rng(0).standard_normal(size) * 0.1).astype(np.float32)
    for number in range(max(ROUNDS, every) if rounds is None else rounds):
        def run(batches: Iterator[pd.DataFrame], start: np.ndarray = flat, number: int = number) -> Iterator[pd.DataFrame]:
            own = (chosen(*row, number) for batch in batches for row in zip(batch["classes"], batch["phases"]))
            trained, seen = train_on(start, own)
            if seen:
                yield pd.DataFrame({"place": np.arange(len(trained), dtype=np.int32), "total": np.rint(trained.astype(float) * UNIT).astype(np.int64) * seen, "n": seen})

        sums = blocks.mapInPandas(run, "place int, total long, n long").groupBy("place").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        if len(sums):
            flat = flat.copy()
            flat[sums["place"].to_numpy()] = sums["total"].to_numpy() / (sums["n"].to_numpy() * float(UNIT))
    return Model(frequent, within, flat)


def score(text: Column, model: Model) -> Column:
    """Struct of n_tokens and score, the summed ln P of every word given both sides; 0 and 0.0 for a text without words."""

    @F.pandas_udf("n_tokens long, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Codes(model.frequent)
        edge = np.full(REACH, EDGE, np.int16)
        for texts in batches:
            sizes, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if held:
                    classes = np.concatenate([x for _, codes in held for x in (classes_of(codes), edge)])
                    codes = np.concatenate([codes for _, codes in held])
                    logs = log_probabilities(model.weights, windows(classes, np.flatnonzero(classes != EDGE))) + model.within[codes]
                    starts = np.cumsum([0, *(len(codes) for _, codes in held[:-1])])
                    for (i, codes), total in zip(held, np.add.reduceat(logs, starts)):
                        sizes[i], sums[i] = len(codes), total
                    held.clear()

            waiting = 0
            for i, text in enumerate(texts):
                codes = own.of(text)
                if len(codes):
                    held.append((i, codes))
                    waiting += len(codes)
                if waiting >= 4 * CHUNK:
                    settle()
                    waiting = 0
            settle()
            yield pd.DataFrame({"n_tokens": sizes, "score": sums})

    return run(text)
