"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents stand in a shuffled line that is cut into blocks of
equally many words.  A schedule of slots, one block each, maps the points of the
van der Corput sequence through the cumulative weights of the sources, so every
stretch of the mix holds the sources nearly in their target shares.  The n-th
slot of a source takes the n-th block of its line, starting over at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable

from .common import fresh, n_words, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
#: Hash ranges of a source's line, slots counted as one range, and cells of the unit interval.
LINE_RANGES, SLOT_RANGE, CELLS = 2048, 1024, 4096


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, low, high) of each source of `sizes` (source, size).

    Sources by code point, NULL last, take the weights in turn and split `share`
    of all words by weight.  No target is above `most` times the source's size;
    what is above goes to the others by weight.  Sources saturate in the order of
    size over weight, so one running sum finds the level at which none is above.
    [low, high) is the source's part of the unit interval.  The table has one
    row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "place")
    picks = F.array(*(F.lit(float(w)) for w in weights))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = (
        sums.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(picks, F.col("place") % len(weights)))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
        .withColumn("rate", (share * F.col("total") - F.col("before")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("rate") <= F.col("need"), F.col("rate"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    )
    rows = rows.withColumn("sofar", F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.max("sofar").over(Window.partitionBy())
    ends = rows.withColumn("high", F.when(whole > 0, F.col("sofar") / whole).otherwise(F.lit(0.0)))
    return ends.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0))).select(
        "source", "source_size", "target", "low", "high")


def van_der_corput(i: Column) -> Column:
    """The i-th point of the base-2 sequence: the binary digits of i, mirrored behind the point; exact below 2^53."""
    digits = F.bin(i)
    return F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))


def _line(rows: DataFrame) -> DataFrame:
    """Where each document of more than no words starts in its source's shuffled line.

    The order is that of a digest of the doc_id.  A line is summed range by
    range, so a hot source is spread over many tasks.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = rows.withColumn("digest", digest).withColumn(
        "range", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * (LINE_RANGES / 2**32)).cast("int"))
    inner = Window.partitionBy("source", "range").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn(
        "offset", F.coalesce(F.sum("words").over(outer), F.lit(0))).select(
        F.col("source").alias("source2"), F.col("range").alias("range2"), "offset")
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("source2")) & (F.col("range") == F.col("range2"))
    return placed.join(starts, on).withColumn("start", F.col("within") + F.col("offset")).drop(
        "source2", "range2", "digest", "range", "within", "offset")


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, turn): which source each slot of the mix takes, and how many slots it had before.

    `goals` is what targets() returns.  Slots beyond a source's target are left
    out; a source that the points leave short of it, by its discrepancy of a few
    blocks, gets the missing turns at the end of the mix.
    """
    spark = goals.sparkSession
    size, goal = F.col("source_size"), F.round("target").cast("long")
    needed = F.expr(f"(goal div source_size) * ceil(source_size / {block_words}D) + ceil((goal % source_size) / {block_words}D)")
    plan = durable(
        goals.where(size > 0).withColumn("goal", goal).where("goal > 0").withColumn("needed", needed.cast("long")))
    total = plan.agg(F.sum("needed")).first()[0] or 0
    points = spark.range(1, total + 1).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u"))
    cells = plan.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))))
    cells = small(durable(cells.select("source", "low", "high", "cell")))
    met = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= low and u < high").select("slot", "source")
    ranged = met.withColumn("range", F.expr(f"slot div {SLOT_RANGE}"))
    inner = Window.partitionBy("source", "range").orderBy("slot")
    outer = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("source", "range").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    before = before.select(F.col("source").alias("source2"), F.col("range").alias("range2"), "before", "n")
    counts = before.groupBy(F.col("source2")).agg(F.sum("n").alias("had"))
    turns = (
        ranged.withColumn("rank", F.row_number().over(inner) - 1)
        .join(before, F.col("source").eqNullSafe(F.col("source2")) & (F.col("range") == F.col("range2")))
        .withColumn("turn", F.col("before") + F.col("rank")).drop("source2")
        .join(small(plan).select(F.col("source").alias("source2"), "needed"), F.col("source").eqNullSafe(F.col("source2")))
        .where("turn < needed").select("slot", "source", "turn")
    )
    short = plan.join(counts, F.col("source").eqNullSafe(F.col("source2")), "left").withColumn("had", F.coalesce("had", F.lit(0)))
    late = short.where("had < needed").select(
        "source", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("turn"))
    return turns.union(late.select((F.lit(total + 1) + F.col("turn")).alias("slot"), "source", "turn"))


def _mixture(docs: DataFrame, weights: Sequence[int], share: float, most: int, block_words: int) -> tuple[DataFrame, ...]:
    """Sizes, targets, lines and the mix itself: what each slot takes of each document."""
    rows = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    goals = durable(targets(rows, weights, share, most))
    line = durable(_line(rows.where("size > 0")))
    facts = small(goals).select(
        F.col("source").alias("source2"), "source_size", F.round("target").cast("long").alias("goal"))
    turns = schedule(goals, block_words).join(facts, F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    blocks = F.ceil(F.col("source_size") / F.lit(float(block_words)))
    used = (
        turns.withColumn("blocks", blocks).withColumn("block", F.col("turn") % F.col("blocks"))
        .withColumn("past", F.expr("turn div blocks") * F.col("source_size") + F.col("block") * block_words)
        .withColumn("words", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.col("goal") - F.col("past")))
        .select("slot", F.col("source").alias("source2"), F.col("block").alias("block2"), F.col("words").alias("block_size"))
    )
    cut = line.withColumn("block", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    on = F.col("source").eqNullSafe(F.col("source2")) & (F.col("block") == F.col("block2"))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("block_size"))
    parts = cut.join(used, on).select(
        "slot", "source", "doc_id", "size", F.col("start").alias("line"), (first - F.col("start")).alias("start"),
        (last - first).alias("words")).where("words > 0")
    return rows, goals, line, parts


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (slot, source, doc_id, size, start, words), `words` words of a document from word `start` on.

    Slots follow the low-discrepancy schedule, so every stretch of them holds
    the sources near their shares; within a slot, documents follow their
    source's shuffled line.  mix() sums what is taken of each document.
    """
    return _mixture(docs, weights, share, most, block_words)[3].drop("line")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of (doc_id, text, source, ...) as (doc_id, size, source_size, target, taken).

    `size` is the number of words, 0 for a NULL text; `target` how many words the
    mix wants of the row's source, `taken` how many it takes of this document,
    repeats counted.  A source gives its target, rounded to a word; a document
    gives at most `most` times its size.  NULL is a source of its own.  The order
    within a source depends on doc_ids alone, so reruns agree; rows that repeat a
    doc_id and a size are interchangeable.  An empty table gives an empty one.
    """
    rows, goals, line, parts = _mixture(docs, weights, share, most, block_words)
    gained = parts.groupBy(F.col("source").alias("source2"), F.col("line").alias("start2")).agg(F.sum("words").alias("taken"))
    full = line.join(gained, F.col("source").eqNullSafe(F.col("source2")) & (F.col("start") == F.col("start2")), "left").select(
        "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    every = full.union(rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    sizes = small(goals).select(F.col("source").alias("source2"), "source_size", "target")
    return every.join(sizes, F.col("source").eqNullSafe(F.col("source2"))).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: each as often as it is taken, to the nearest whole document, so from 0 to 2 times.

    All columns of `docs` are kept.  A document without a word is not taken.
    Rows of equal doc_id, source and size share what the mix takes of them evenly.
    """
    number, missing, size, times, count, rank, other = fresh(
        docs, "number", "missing", "size", "times", "count", "rank", "source_key")
    keys = {number: F.coalesce("doc_id", F.lit(0)), missing: F.col("doc_id").isNull(), other: F.to_json(F.struct("source"))}
    takes = mix(docs, **how).where("size > 0").withColumns(keys).groupBy(
        number, missing, other, F.col("size").alias(size)).agg(
        F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(times)).where(F.col(times) > 0)
    sized = docs.withColumns(keys).withColumn(size, n_words(F.col("text")))
    met = sized.join(takes, [number, missing, other, size])
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
