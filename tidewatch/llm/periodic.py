"""Runs of periodic repetition in the words of a text, by block convolution.

At each dyadic scale L the text is cut into blocks of L words.  A number
transform gives, exactly and for all distances of a following window at once,
the sum of squared differences between a block and what stands that far behind
it; where it is zero the block occurs again.  Each such distance is a seed that
is extended, word by word, to the longest stretch of that period.  A run of
period q holds an aligned block of L = about q/2 words whose next copy lies in
the run as well, so the scale that looks at distances around q finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least words of a run, and least times that it repeats its period.
LEAST, TIMES = 12, 2
#: The modulus, 7 * 2^20 + 1 (prime, so there are transforms of up to 2^20 places), and a generator of its units.
PRIME, ROOT = 7 * (1 << 20) + 1, 3
#: Places of the longest transform, of one done as a single product, and numbers held at a time.
LONGEST, DIRECT, HELD = 1 << 16, 128, 1 << 16
#: Words after which a task turns to the texts it holds.
WORDS = 1 << 17


def _mod(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^53 as residues between -PRIME/2 and PRIME/2."""
    out = x * (1 / PRIME)
    np.rint(out, out=out)
    out *= PRIME
    return np.subtract(x, out, out=out)


@lru_cache(maxsize=None)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """Residues of the n-th roots of unity."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * w % PRIME)
    return _mod(np.array(out, float))


@lru_cache(maxsize=None)
def _matrix(n: int, inverse: bool) -> np.ndarray:
    return _powers(n, inverse)[np.outer(np.arange(n), np.arange(n)) % n]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number transform of each row, exact modulo PRIME: products of residues are below 2^44, and at most DIRECT of them are added."""
    n = x.shape[1]
    if n <= DIRECT:
        return _mod(x @ _matrix(n, inverse))
    a = 1 << (n.bit_length() - 1) // 2  # n = a * b places as a table
    b = n // a
    columns = np.ascontiguousarray(x.reshape(-1, a, b).transpose(0, 2, 1)).reshape(-1, a)
    columns = transform(columns, inverse).reshape(-1, b, a)
    turn = _powers(n, inverse)[np.outer(np.arange(b), np.arange(a)) % n]
    rows = np.ascontiguousarray(_mod(columns * turn).transpose(0, 2, 1)).reshape(-1, b)
    return np.ascontiguousarray(transform(rows, inverse).reshape(-1, a, b).transpose(0, 2, 1)).reshape(-1, n)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which block occurs at which place of its own window: (block, place), among places where it lies in it whole.

    Rows are residues.  The squared differences of block x and window y at place
    d add up to sum x^2 + sum y^2 - 2 sum x(i) y(i+d), taken modulo PRIME.
    """
    count, size = blocks.shape
    length = windows.shape[1]
    n = 1 << (length - 1).bit_length()
    padded = np.zeros((count, n))
    padded[:, :length] = windows
    back = np.zeros((count, n))
    back[:, -np.arange(size) % n] = blocks
    products = transform(_mod(transform(padded) * transform(back)), inverse=True)[:, :length - size + 1]
    products = _mod(products * _mod(np.array([float(pow(n, -1, PRIME))])))
    squares = np.cumsum(np.pad(_mod(windows * windows), ((0, 0), (1, 0))), axis=1)
    total = squares[:, size:] - squares[:, :-size] + _mod(blocks * blocks).sum(axis=1, keepdims=True) - 2 * products
    return np.nonzero(_mod(total) == 0)


def scale_of(period: int) -> int:
    """Block length that finds runs of a period: an aligned block and its copy lie inside the shortest such run."""
    room = max(LEAST, TIMES * period) - period
    return 1 << (((room + 1) // 2).bit_length() - 1)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block length, least and greatest distance) that cover all periods of a text of so many words."""
    q, most = 1, longest // TIMES
    while q <= most:
        size, end = scale_of(q), q
        while end < most and scale_of(end + 1) == size and end < q + 2 * size:
            end += 1
        yield size, q, end
        q = end + 1


def _seeds(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, distance) of blocks that occur again `low` to `high` words on, within the same text."""
    counts = np.maximum(ends - starts - size - low, -1) // size + 1
    at = np.repeat(starts - (np.cumsum(counts) - counts) * size, counts) + np.arange(counts.sum()) * size
    size = min(size, LONGEST // 4)  # of longer blocks the beginning is looked for
    for first in range(low, high + 1, 2 * size):
        places = min(2 * size, high + 1 - first)
        rows = max(1, HELD // (4 * size + places))
        for i in range(0, len(at), rows):
            part = at[i:i + rows]
            blocks = values[part[:, None] + np.arange(size)]
            reach = part[:, None] + first + np.arange(places + size - 1)
            windows = values[np.minimum(reach, len(values) - 1)]
            b, d = zero_mismatches(blocks, windows)
            if len(b):
                yield part[b], d + first


def _extend(ids: np.ndarray, start: int, end: int, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ids[at:at + period] in ids[start:end] that keeps the period."""
    left, right, step = at, at, 64
    while left > start:
        n = min(step, left - start)
        bad = np.flatnonzero(ids[left - n:left] != ids[left - n + period:left + period])
        if len(bad):
            left += int(bad[-1]) + 1 - n
            break
        left, step = left - n, 2 * step
    step = 64
    while right + period < end:
        n = min(step, end - period - right)
        bad = np.flatnonzero(ids[right:right + n] != ids[right + period:right + period + n])
        if len(bad):
            right += int(bad[0])
            break
        right, step = right + n, 2 * step
    return left, right + period


def _primitive(ids: np.ndarray, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one; a smaller one would divide it."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(ids[part:], ids[:-part]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of word numbers, by start, then period.

    Sequences are searched together, so short ones cost no calls of their own;
    an occurrence that reaches into the next text is dropped.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return found
    ids = np.concatenate(texts)
    values = _mod((ids % PRIME).astype(float) * 2654435.0)
    starts = np.cumsum(sizes) - sizes
    for size, low, high in scales(int(sizes.max())):
        long = np.flatnonzero(sizes >= max(LEAST, TIMES * low))
        for at, distance in _seeds(values, starts[long], starts[long] + sizes[long], size, low, high):
            where = np.searchsorted(starts, at, side="right") - 1
            inside = at + distance + size <= starts[where] + sizes[where]
            at, distance, where = at[inside], distance[inside], where[inside]
            # one seed for each text and distance, then those that it does not explain
            while len(at):
                text = int(where[0])
                start, end = int(starts[text]), int(starts[text] + sizes[text])
                mine = where == text
                open_ = mine.copy()
                for s, n, q in found[text]:
                    open_ &= ~((distance % q == 0) & (at >= start + s) & (at + distance + size <= start + s + n))
                while open_.any():
                    i = int(open_.argmax())
                    q = int(distance[i])
                    s, e = _extend(ids, start, end, int(at[i]), q)
                    open_ &= ~((distance == q) & (at >= s) & (at + q < e))
                    open_[i] = False
                    run = (s - start, e - s, q)
                    if e - s >= max(LEAST, TIMES * q) and run not in found[text] and _primitive(ids[s:e], q):
                        found[text].append(run)
                        open_ &= ~((distance % q == 0) & (at >= s) & (at + distance + size <= e))
                at, distance, where = at[~mine], distance[~mine], where[~mine]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def runs(text: Column) -> Column:
    """Struct of a text's `runs` (start, length, period), by start, then period, and of `collapsed`, its words without the repeats.

    Words are split at ASCII white space and numbered from 0; `collapsed` joins
    those that stay by one space.  A run is a longest stretch of at least twelve
    words and of two periods, under its smallest period; all are found, however
    long text and period.  NULL, empty and blank texts have no run and collapse
    to the empty text.
    """

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            held: list[list[bytes]] = []
            size = 0
            for i, text in enumerate(texts):
                held.append((text or "").encode("utf-8", "surrogatepass").split())
                size += len(held[-1])
                if size >= WORDS or i + 1 == len(texts):
                    numbers: dict[bytes, int] = {}
                    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in held]
                    found = find_runs(ids)
                    yield pd.DataFrame({
                        "runs": pd.Series([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], dtype=object),
                        "collapsed": [b" ".join(kept_words(words, f)).decode("utf-8", "surrogatepass") for words, f in zip(held, found)]})
                    held, size = [], 0

    return run(text)
