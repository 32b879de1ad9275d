"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A document must pass every rule, so the order of the rules changes nothing but
the cost.  Each rule's cost and rejections are measured on a sample, the rules
are ordered by rejections per cost, and one conditional expression evaluates
them until the first rejects.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable

from .common import WORD, fresh

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Rows of the sample that orders the rules; the verdict does not depend on it.
SAMPLE_ROWS = 2000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
GAP = r"\x20\x09-\x0D"


def counts(docs: DataFrame, names: tuple[str, ...], words: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words under `names`, and the word array `words`.

    Repeated windows are found on 64-bit hashes: only a text in which some hash
    comes twice has its windows sorted, and the positions they cover counted.
    """
    n, chars, symbols, lines_, repeats = names
    lines, hashes, twice = fresh(docs, "lines", "hashes", "twice")
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn(words, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    step = step.withColumns({
        n: F.size(words).cast("long"),
        chars: F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        symbols: (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        lines: F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0),
    })
    at = ", ".join(f"get({words}, i + {k})" for k in range(WINDOW))
    step = step.withColumn(hashes, F.expr(
        f"case when {n} > {WINDOW} then transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({at})) else array() end"))
    step = step.withColumns({
        lines_: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        twice: F.size(F.array_distinct(hashes)) < F.size(hashes),
    })
    # window starts in order of their hash; those with an equal neighbour, in page order; then the words they cover
    starts = (
        f"array_sort(transform(filter(zip_with(zip_with(s, slice(s, 2, size(s)), (x, y) -> struct(x, y)),"
        f" concat(array(cast(null as struct<h: bigint, i: int>)), slice(s, 1, size(s) - 1)),"
        f" (xy, z) -> struct(xy.x.i as i, xy.x.h <=> xy.y.h or xy.x.h <=> z.h as hit)), e -> e.hit), e -> e.i))"
    )
    ordered = f"sort_array(transform({hashes}, (h, i) -> struct(h, i)))"
    covered = (
        f"aggregate(transform(array({ordered}), s -> {starts})[0], struct(0L as n, -{WINDOW} as last),"
        f" (acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) as n, i as last), acc -> acc.n)"
    )
    return step.withColumn(repeats, F.when(F.col(twice), F.expr(covered)).otherwise(F.lit(0)).cast("long")).drop(lines, hashes, twice)


def rules(names: tuple[str, ...], words: str, text: str = "text") -> dict[str, Column]:
    """What rejects a document beyond the base rules: true means out.  No value is NULL for a document with words."""
    n, chars, symbols, lines_, _ = (F.col(x) for x in names)
    letters = F.regexp_count(text, F.lit(rf"[^{GAP}\p{{L}}]*+\p{{L}}[^{GAP}]*+"))
    loud = F.regexp_count(text, F.lit(rf"!!(?=[{GAP}]|\z)"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    stutter = F.expr(f"size(filter(zip_with({words}, slice({words}, 2, size({words})), (a, b) -> a = b), x -> x))")
    return {
        "symbols": 10 * symbols > n,
        "word_length": (chars < 2 * n) | (chars > 15 * n),
        "repeated_lines": 2 * lines_ > F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")),
        "few_letters": 10 * letters < 6 * n,
        "exclamations": 2 * loud > n,
        "shouting": 10 * capitals > 7 * chars,
        "stutter": 3 * stutter > n,
    }


def measured(sample: DataFrame, rule: Column | None) -> tuple[int, float]:
    """How many rows of a sample a rule rejects, and the seconds that took; without a rule, of reading the rows."""
    began = time.perf_counter()
    hits = sample.agg(F.count("*") if rule is None else F.coalesce(F.sum(rule.cast("long")), F.lit(0))).first()[0]
    return hits, time.perf_counter() - began


def order(sample: DataFrame, conditions: Mapping[str, Column]) -> list[str]:
    """The rules' names by rejections per second on a sample, best first; ties by name."""
    measured(sample, None)
    idle, rate = measured(sample, None)[1], {}
    for name, rule in conditions.items():
        hits, seconds = measured(sample, rule)
        rate[name] = hits / max(seconds - idle, 0.001)
    return sorted(conditions, key=lambda name: (-rate[name], name))


def cascade(conditions: Mapping[str, Column], names: list[str]) -> Column:
    """The name of the first rule that rejects, in the given order; NULL if none does."""
    chain = F.lit(None).cast("string")
    for name in reversed(names):
        chain = F.when(conditions[name], F.lit(name)).otherwise(chain)
    return chain


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, and no other column than doc_id.

    A NULL or empty text has no word, fails the base rules and is not kept.
    Repeated rows are judged alike; columns of these names in the input don't
    matter.  Only the order of the rules depends on the sample, a random share
    of about `sample_rows` documents; an empty table gives an empty one.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = docs.select("doc_id", "text")
    return _judged(rows, names, "words", sample_rows).select("doc_id", *names, "base_failed", "kept")


def _judged(rows: DataFrame, names: tuple[str, ...], words: str, sample_rows: int, base: str = "base_failed", kept: str = "kept") -> DataFrame:
    counted = counts(rows, names, words)
    conditions = rules(names, words)
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = durable(counts(rows.sample(share, seed=7), names, words))
    chain = cascade(conditions, order(sample, conditions))
    n, repeats = F.col(names[0]), F.col(names[4])
    judged = counted.withColumn(base, (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n))
    # a filter on the verdict must not be pushed below the columns that it is made of: the word array would be split anew
    # for every word; the optimizer leaves a projection with a random number where it is (no word count is below 0)
    return judged.withColumn(kept, F.when(F.col(base) | (F.rand(0) > n + 1), F.lit(False)).otherwise(chain.isNull()))


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that judge() keeps, with all their columns."""
    *names, words, base, kept = fresh(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words", "base_failed", "kept")
    return _judged(docs, tuple(names), words, sample_rows, base, kept).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
