"""Exact URL and near-duplicate removal.

Near-duplicates follow the sequential rule "keep an item unless an earlier
*kept* item reaches the similarity threshold", computed without a sequential
pass and without comparing all pairs of a crowded bucket.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minhash as mh
from ..functions import times, vocab
from ..session import discard, durable, stored as columns
from .components import components, join_skewed

# Buckets up to this size may list their pairs; larger ones go through leaders, then through rare places, then through blocks.
PAIR_BUCKET = 200
# Leader rounds: each dissolves groups of copies, whatever their size.
LEADER_ROUNDS = 2
# Items of a crowded bucket on either side of one comparing task, and comparisons of one salt of a semi join.
BLOCK, SALT_PAIRS = 2000, 1_000_000
# Counters of the places of signatures, as a power of two: places that share one count as equally frequent.
COUNTER_BITS = 20
# Rounds of settling the pair graph before what is left of each component is walked in order.
SETTLE_ROUNDS = 8


def first_per_key(df: DataFrame, key: Column | str, order: list[Column | str], latest: bool = False) -> DataFrame:
    """One row per key: the first under `order`, or the last with `latest`.

    A combinable aggregate: a key holding a third of all rows is reduced on the
    map side.  NULL keys form one group.
    """
    key = F.col(key) if isinstance(key, str) else key
    pick = F.max_by if latest else F.min_by
    keyed = df.select(key.alias("_key"), F.struct(*order).alias("_order"), F.struct(*df.columns).alias("_row"))
    return keyed.groupBy("_key").agg(pick("_row", "_order").alias("_row")).select("_row.*")


def drop_known_urls(batch: DataFrame, stored: DataFrame | None, order: list[Column | str] | None = None) -> DataFrame:
    """Rows with a URL that is neither stored nor seen earlier in the batch."""
    fresh = batch.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    fresh = first_per_key(fresh, "url", order or ["timestamp", "id"])
    if stored is not None:
        # only stored rows with a URL of the batch are moved beyond their partition; a semi join needs no distinct URLs
        met = stored.select("url").join(fresh.select("url"), "url", "left_semi")
        fresh = fresh.join(met.groupBy("url").agg(F.count("*").alias("_n")).select("url"), "url", "left_anti")
    return fresh.select(*batch.columns)


def recent_signatures(stored: DataFrame, as_of: dt.datetime, hours: int = vocab.NEAR_DUP_HOURS) -> DataFrame:
    """Stored rows ingested within the look-back that carry a signature."""
    cutoff = times.literal_like(stored, "created_at", as_of - dt.timedelta(hours=hours))
    return stored.filter((F.col("created_at") >= cutoff) & F.col("minhash_signature").isNotNull())


def _banded(sigs: DataFrame, threshold: float, num_perm: int, carry: list[str]) -> DataFrame:
    """One row per item and band: carry columns and the band's hash, which no other band shares."""
    hashes = mh.band_hashes(F.col("sig"), threshold, num_perm)
    hashes = F.coalesce("bands", hashes) if "bands" in sigs.columns else hashes
    return sigs.select(*carry, F.explode(hashes).alias("key"))


def near_duplicates(batch: DataFrame, stored: DataFrame, threshold: float = vocab.NEAR_DUP_THRESHOLD,
                    id_col: str = "id", signature_col: str = "minhash_signature",
                    num_perm: int = vocab.NUM_PERM, bands_col: str | None = None) -> DataFrame:
    """Ids of batch rows whose estimated similarity to any stored row reaches the threshold.

    `bands_col` names a column of both sides that keeps the band hashes of this
    threshold and signature length, so that a stored signature is banded once in
    its life; rows without them are banded here.

    Buckets are made of 64-bit hashes that stand for the signatures, so copies
    collapse and a signature moves only if some bucket has members on both
    sides.  A row is compared with two stored members of each of its buckets,
    which settles groups of copies in linear work.  For the rows still open,
    small buckets list their pairs, and members of crowded ones meet by their
    rarest places, as in greedy_verdicts; where that too is crowded, the
    comparison is a salted semi join, which lists no pairs.
    """
    need = mh.needed_matches(threshold, num_perm)
    bands = [F.col(bands_col).alias("bands")] if bands_col else []
    side = [F.col(signature_col).alias("sig"), F.xxhash64(signature_col).alias("h"), *bands]
    mine = batch.select(F.col(id_col).alias("item"), *side).filter("sig is not null")
    theirs = stored.select(*side).filter("sig is not null")
    left = _banded(mine, threshold, num_perm, ["h"]).distinct()
    right = _banded(theirs, threshold, num_perm, ["h"]).distinct()
    ends = right.groupBy("key").agg(F.count("*").alias("m"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    rows = durable(left.join(ends, "key").select("h", "key", "m", "lo", "hi"))
    others = durable(right.join(rows.select("key").distinct(), "key", "left_semi"))
    asking = durable(mine.select("item", "h", "sig").join(rows.select("h").distinct(), "h", "left_semi"))
    sig_l = asking.groupBy("h").agg(F.first("sig").alias("sig"))
    sig_r = durable(theirs.select("h", "sig").join(others.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("sig").alias("sig")))

    def hits(pairs: DataFrame) -> DataFrame:
        met = pairs.distinct().join(sig_l, "h").join(sig_r.select(F.col("h").alias("other"), F.col("sig").alias("sig_r")), "other")
        return met.filter(mh.matches(F.col("sig"), F.col("sig_r")) >= need).select("h").distinct()

    found = durable(hits(rows.select("h", F.explode(F.array("lo", "hi")).alias("other"))))
    rest = durable(rows.filter("m > 2").join(found, "h", "left_anti").select("h", "key", "m"))
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    crowded = F.greatest("n", "m") > PAIR_BUCKET
    met = others.withColumnRenamed("h", "other")
    few = rest.select("h", "key").join(sizes.filter(~crowded).select("key"), "key").join(met, "key")
    found = found.unionByName(hits(few.select("h", "other")))
    hot = durable(sizes.filter(crowded).select("key"))
    if not hot.isEmpty():
        found = found.unionByName(_crowded_hits(rest.join(hot, "key", "left_semi"), others.join(hot, "key", "left_semi"), sig_l, sig_r, hits, need, num_perm))
    return asking.join(found.distinct(), "h", "left_semi").select(F.col("item").alias(id_col))


def _crowded_hits(left: DataFrame, right: DataFrame, sig_l: DataFrame, sig_r: DataFrame,
                  hits: Callable[[DataFrame], DataFrame], need: int, num_perm: int) -> DataFrame:
    """The hashes `h` of the left members of crowded buckets that some right member reaches, met by their rarest places."""
    def members(rows: DataFrame, sigs: DataFrame, mine: bool) -> DataFrame:
        return rows.select("h").distinct().join(sigs, "h").select(F.struct(F.lit(mine).alias("mine"), "h").alias("rank"), "sig")

    keys = durable(_rare_keys(members(left, sig_l, True).unionByName(members(right, sig_r, False)), need, num_perm).select("key", "rank.*"))
    sizes = keys.groupBy("key").agg(F.count_if("mine").alias("n"), F.count_if(~F.col("mine")).alias("m")).filter("n > 0 and m > 0")
    sizes = durable(sizes)
    crowded = F.greatest("n", "m") > PAIR_BUCKET
    a, b = keys.filter("mine").select("key", "h"), keys.filter("not mine").select("key", F.col("h").alias("other"))
    few = sizes.filter(~crowded).select("key")
    found = hits(a.join(few, "key", "left_semi").join(b, "key").select("h", "other"))
    # a bucket crowded on both sides is dealt over tasks: each row of one side once, of the other to every salt
    salted = sizes.filter(crowded).select("key", F.ceil(F.col("n") * F.col("m") / SALT_PAIRS).alias("salts"))
    x = a.join(salted, "key").join(sig_l, "h").select("key", "h", "sig", F.pmod(F.xxhash64("h"), F.col("salts")).alias("salt")).alias("x")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))
    y = b.join(salted, "key").join(sig_r, b["other"] == sig_r["h"]).select("key", "sig", every.alias("salt")).alias("y")
    alike = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (mh.matches(F.col("x.sig"), F.col("y.sig")) >= need)
    return found.unionByName(x.join(y, alike, "left_semi").select("h").distinct())


def _near_by_sketch(need: int, num_perm: int) -> Column:
    """Whether two signatures may reach the threshold, by their sketches."""
    return F.coalesce(mh.most_matches(F.col("sketch_l"), F.col("sketch_e"), num_perm) >= need, F.lit(True))


def _verified(pairs: DataFrame, sigs: DataFrame, need: int, num_perm: int) -> DataFrame:
    """Pairs (later, earlier) of signature ranks whose signatures reach the threshold.

    Sketches meet first: by them most pairs cannot reach it.  Signatures move
    only for the pairs that are left.
    """
    later = sigs.select(F.col("rank").alias("later"), F.col("sketch").alias("sketch_l"))
    earlier = sigs.select(F.col("rank").alias("earlier"), F.col("sketch").alias("sketch_e"))
    close = pairs.distinct().join(later, "later").join(earlier, "earlier").filter(_near_by_sketch(need, num_perm))
    close = columns(close.select("later", "earlier"))
    wanted = columns(close.select(F.explode(F.array("later", "earlier")).alias("rank")).distinct())
    held = sigs.select("rank", "sig").join(wanted, "rank", "left_semi")
    return (
        close.join(held.select(F.col("rank").alias("later"), F.col("sig").alias("sig_l")), "later")
        .join(held.select(F.col("rank").alias("earlier"), F.col("sig").alias("sig_e")), "earlier")
        .filter(mh.matches(F.col("sig_l"), F.col("sig_e")) >= need)
        .select("later", "earlier")
    )


def _rare_keys(members: DataFrame, need: int, num_perm: int) -> DataFrame:
    """(key, rank): the rarest places of each signature that it has to share with any other of the required similarity.

    Signatures that agree in `need` of `num_perm` places share one of each
    other's num_perm - need + 1 rarest (place, value) pairs, in any order that
    holds for all.  Here the order is that of counts in COUNTERS counters, which
    several pairs may share, so only the counters and those keys leave a task.
    """
    prefix, odd = num_perm - need + 1, np.uint64(0x9E3779B97F4A7C15)

    def places(sigs: pd.Series) -> np.ndarray:
        matrix = np.stack(sigs.to_list()).astype(np.uint64)
        mixed = ((matrix << np.uint64(8)) + np.arange(matrix.shape[1], dtype=np.uint64)) * odd
        return (mixed ^ (mixed >> np.uint64(29))) * odd

    def counter(mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            if len(batch):
                seen += np.bincount(counter(places(batch["sig"])).ravel(), minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"at": used, "n": seen[used]})

    # the driver gets a number for each counter at most
    counts = members.select("sig").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << COUNTER_BITS, np.int64)
    table[counts["at"].to_numpy()] = counts["n"].to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<long>")
    def rarest(sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        mixed = places(sigs)
        held = shared.value[counter(mixed)]
        keys = mixed.view(np.int64)
        # equal counts are in the order of the keys
        order = np.lexsort((keys, held), axis=1)[:, :prefix]
        return pd.Series(list(np.take_along_axis(np.where(held > 1, keys, 0), order, axis=1)))

    keyed = members.select("rank", F.explode(F.array_distinct(rarest("sig"))).alias("key")).filter("key <> 0")
    return keyed.select("key", "rank")


def _crowded_pairs(rows: DataFrame, sizes: DataFrame, sigs: DataFrame, need: int) -> DataFrame:
    """Pairs (later, earlier) within crowded buckets whose signatures reach the threshold.

    The members of a bucket are dealt to blocks, and every two blocks meet in a
    task of their own that compares signatures as matrices and returns only the
    pairs that qualify.
    """
    numbered = durable(sigs.join(rows.join(sizes, "key", "left_semi").select("rank").distinct(), "rank", "left_semi").withColumn(
        "no", F.monotonically_increasing_id()))
    blocks = sizes.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    member = rows.join(blocks, "key").join(numbered, "rank").withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    met = member.select("key", "no", "sig", "own", F.explode(other).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "no", "sig")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, sides = pdf["no"].to_numpy(), pdf["own"].to_numpy()
        matrix = np.stack(pdf["sig"].to_list())
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        second = np.flatnonzero(sides == j)
        x, y = [], []
        for at in np.flatnonzero(sides == i):
            near = second[(matrix[second] == matrix[at]).sum(axis=1) >= need]
            near = near[near > at] if i == j else near
            x.append(np.full(len(near), numbers[at]))
            y.append(numbers[near])
        return pd.DataFrame({"x": np.concatenate([*x, numbers[:0]]), "y": np.concatenate([*y, numbers[:0]])})

    found = met.groupBy("key", "i", "j").applyInPandas(compare, "x bigint, y bigint").distinct()
    one = numbered.select(F.col("no").alias("x"), F.col("rank").alias("rank_x"))
    two = numbered.select(F.col("no").alias("y"), F.col("rank").alias("rank_y"))
    return found.join(one, "x").join(two, "y").select(
        F.greatest("rank_x", "rank_y").alias("later"), F.least("rank_x", "rank_y").alias("earlier"))


def _walked(edges: DataFrame) -> DataFrame:
    """The rule on the edges of each connected component, in arrival order: dropped items and the first kept item they copy.

    Each component's edges stream through a task, sorted by Spark, so a chain or
    a template of any size needs a byte an item there and no more.
    """
    numbered = edges.select(F.xxhash64("later").alias("a"), F.xxhash64("earlier").alias("b"), "later", "earlier")
    roots = components(numbered.select("a", "b"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # edges come by component, then in arrival order, whose numbers stand for the items; a byte an item is all that is held
        root, dropped = None, bytearray()
        for batch in batches:
            out = []
            for r, later, earlier in zip(batch["root"].tolist(), batch["l"].tolist(), batch["e"].tolist()):
                if r != root:
                    root, dropped = r, bytearray()
                if later >= len(dropped):
                    dropped.extend(bytes(later - len(dropped) + 1024))
                if not dropped[later] and not dropped[earlier]:
                    dropped[later] = 1
                    out.append((r, later, earlier))
            yield pd.DataFrame(out, columns=["root", "l", "e"], dtype="int64")

    placed = durable(numbered.join(roots, numbered["a"] == roots["node"]).select("root", "later", "earlier"))
    items = placed.select("root", F.col("later").alias("item")).union(placed.select("root", "earlier")).distinct()
    order = durable(items.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("item")).cast("bigint")))
    later = order.select("root", F.col("item").alias("later"), F.col("n").alias("l"))
    earlier = order.select("root", F.col("item").alias("earlier"), F.col("n").alias("e"))
    walks = placed.join(later, ["root", "later"]).join(earlier, ["root", "earlier"]).select("root", "l", "e")
    found = walks.repartition("root").sortWithinPartitions("root", "l", "e").mapInPandas(walk, "root bigint, l bigint, e bigint")
    return found.join(later, ["root", "l"]).join(earlier, ["root", "e"]).select(F.col("later").alias("rank"), F.col("earlier").alias("copy_of"))


def _settle(edges: DataFrame) -> DataFrame:
    """Resolve the keep-unless-earlier-kept rule on an explicit pair graph.

    Each round, items without an open earlier neighbour are kept and their
    later neighbours dropped; edges of dropped items disappear, which may free
    others.  Long chains are left after SETTLE_ROUNDS; what remains of each
    component is walked in order.  Returns the dropped items with a kept item
    they copy.
    """
    dropped = None
    for _ in range(SETTLE_ROUNDS):
        blocked = edges.select(F.col("later").alias("earlier")).distinct()
        losers = durable(
            edges.join(blocked, "earlier", "left_anti")
            .groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("copy_of"))
        )
        dropped = losers if dropped is None else dropped.unionByName(losers)
        gone = losers.select("rank")
        edges = durable(
            edges.join(gone.withColumnRenamed("rank", "later"), "later", "left_anti")
            .join(gone.withColumnRenamed("rank", "earlier"), "earlier", "left_anti")
            .select("later", "earlier")
        )
        if edges.isEmpty():
            return dropped
    return dropped.unionByName(_walked(edges))


def greedy_verdicts(items: DataFrame, order: list[str], threshold: float = vocab.NEAR_DUP_THRESHOLD,
                    id_col: str = "id", signature_col: str = "minhash_signature",
                    num_perm: int = vocab.NUM_PERM) -> DataFrame:
    """One row per item: id, kept flag and, for a dropped item, the kept item it copies.

    Items arrive in the order of `order` (ties by id).  Exact for any input:

    1. equal signatures collapse to their first arrival (a combinable aggregate);
    2. while some bucket is crowded, compare members with the bucket's first
       open item only; an item that leads all its buckets is kept.  This is
       linear per round and dissolves groups of copies of any size;
    3. after a fixed number of such rounds, small buckets list their pairs, and
       members of crowded ones meet where they share one of their rarest places,
       which loses no pair; only where so many share a rare place are they
       compared block by block;
    4. the graph of qualifying pairs is settled in a fixed number of rounds and
       one streaming walk over what is left of each component.
    """
    need = mh.needed_matches(threshold, num_perm)
    arrivals = items.select(
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("item")).alias("rank"),
        F.col(signature_col).alias("sig"),
    )
    # two hashes, 128 bits, stand for a signature wherever it would only be compared for equality
    twin = F.when(F.col("sig").isNotNull(), F.struct(F.xxhash64("sig"), F.xxhash64(F.lit("twin"), "sig")))
    hashes = mh.band_hashes(F.col("sig"), threshold, num_perm)
    signed = columns(arrivals.select("rank", "sig", twin.alias("twin"), hashes.alias("bands"), F.monotonically_increasing_id().alias("no")))
    arrivals = columns(signed.select("no", "rank", "twin"))
    # each different signature gets a number in the order of its first arrival, which stands for it from here on
    first = arrivals.groupBy("twin").agg(F.min("rank").alias("first"), F.min("no").alias("no")).orderBy("first")
    names = columns(first.withColumn("rank", F.monotonically_increasing_id()))

    banded = signed.select("no", "bands").join(names.select("no", "rank"), "no").select("rank", F.explode("bands").alias("key"))
    # most items share no bucket with anything: they leave at once, and their signatures with them
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    banded = durable(banded.join(shared.select("key"), "key", "left_semi"))
    members = names.select("no", "rank").join(banded.select("rank").distinct(), "rank", "left_semi")
    sigs = columns(signed.select("no", "sig").join(members, "no").select("rank", "sig", mh.sketch(F.col("sig"), num_perm).alias("sketch")))
    discard(signed)
    open_rows, dropped = banded, None
    for _ in range(LEADER_ROUNDS):
        buckets = open_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rank").alias("lead")).filter("n > 1")
        if (buckets.agg(F.max("n")).first()[0] or 0) <= PAIR_BUCKET:
            break
        following = (
            open_rows.select("key", "rank").join(buckets, "key").filter(F.col("rank") != F.col("lead"))
            .select(F.col("rank").alias("later"), F.col("lead").alias("earlier")).distinct()
        )
        following = durable(following)
        waiting = following.select(F.col("later").alias("rank")).distinct()
        leaders = following.select(F.col("earlier").alias("rank")).distinct().join(waiting, "rank", "left_anti")
        leaders = durable(leaders)
        against = following.join(leaders.withColumnRenamed("rank", "earlier"), "earlier", "left_semi")
        losers = durable(
            _verified(against.select("later", "earlier"), sigs, need, num_perm)
            .groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("copy_of"))
        )
        dropped = losers if dropped is None else dropped.unionByName(losers)
        open_rows = durable(
            open_rows.join(leaders, "rank", "left_anti").join(losers.select("rank"), "rank", "left_anti")
        )

    # pairs of small buckets are bounded by PAIR_BUCKET per row, and only those leave a bucket that may reach the threshold
    # by their sketches; members of crowded ones meet by their rarest places instead
    def meetings(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        lone = rows.join(sizes.filter(F.col("n") <= PAIR_BUCKET).select("key"), "key", "left_semi").join(sigs.select("rank", "sketch"), "rank")
        a = lone.select("key", F.col("rank").alias("later"), F.col("sketch").alias("sketch_l"))
        b = lone.select("key", F.col("rank").alias("earlier"), F.col("sketch").alias("sketch_e"))
        crowded = sizes.filter(F.col("n") > PAIR_BUCKET)
        near = _near_by_sketch(need, num_perm)
        return a.join(b, "key").filter((F.col("later") > F.col("earlier")) & near).select("later", "earlier").distinct(), crowded, rows

    pairs, crowded, rows = meetings(open_rows.select("key", "rank"))
    edges = _verified(pairs, sigs, need, num_perm)
    if not crowded.isEmpty():
        members = rows.join(crowded, "key", "left_semi").select("rank").distinct()
        keys = _rare_keys(columns(sigs.select("rank", "sig").join(members, "rank", "left_semi")), need, num_perm)
        pairs, crowded, rows = meetings(durable(keys))
        edges = edges.unionByName(_verified(pairs, sigs, need, num_perm)).distinct()
        if not crowded.isEmpty():
            edges = edges.unionByName(_crowded_pairs(rows, crowded, sigs.select("rank", "sig"), need)).distinct()
    edges = durable(edges)
    settled = _settle(edges)
    dropped = settled if dropped is None else dropped.unionByName(settled)

    # copies of a signature share the fate of its first arrival
    kept_items = names.select(F.col("rank").alias("copy_of"), F.col("first").alias("of"))
    fate = names.join(dropped.join(kept_items, "copy_of").select("rank", "of"), "rank", "left").select("twin", "first", "of")
    judged = arrivals.select("rank", "twin").join(fate, "twin")
    copy_of = F.coalesce(F.col("of"), F.when(F.col("rank") != F.col("first"), F.col("first")))
    return judged.select(
        F.col("rank.item").alias(id_col),
        copy_of.isNull().alias("kept"),
        copy_of.getField("item").alias("copy_of"),
    )


def drop_near_duplicates(batch: DataFrame, stored: DataFrame | None, order: list[str],
                         threshold: float = vocab.NEAR_DUP_THRESHOLD, id_col: str = "id",
                         signature_col: str = "minhash_signature", num_perm: int = vocab.NUM_PERM,
                         bands_col: str | None = None) -> DataFrame:
    """Batch rows that copy neither a stored row nor an earlier kept row of the batch."""
    fresh = batch
    if stored is not None:
        known = near_duplicates(batch, stored, threshold, id_col, signature_col, num_perm, bands_col)
        fresh = batch.join(known, id_col, "left_anti")
    verdicts = greedy_verdicts(fresh, order, threshold, id_col, signature_col, num_perm)
    return fresh.join(verdicts.filter("kept").select(id_col), id_col, "left_semi")


def exact_jaccard(pairs: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """True shingle-set similarity of (later, earlier) pairs, to check the estimate."""
    from ..functions import text as tx

    sets = texts.select(F.col(id_col).alias("_id"), tx.shingles(F.col(text_col)).alias("_set"))
    both = (
        pairs.join(sets.select(F.col("_id").alias("later"), F.col("_set").alias("_a")), "later")
        .join(sets.select(F.col("_id").alias("earlier"), F.col("_set").alias("_b")), "earlier")
    )
    inter = F.size(F.array_intersect("_a", "_b")).cast("double")
    union = (F.size("_a") + F.size("_b")).cast("double") - inter
    return both.select(*pairs.columns, (inter / union).alias("jaccard"))
