"""Fill-in-the-middle texts, assembled by a secondary sort.

A text is cut into units; two cut points split it into prefix, middle and
suffix.  Tasks emit the parts as pieces of so many units, keyed by document and
by their place in the output.  Pieces are repartitioned by document and sorted
within partitions, so that each output streams past in order, whatever its
length, and is digested as it goes.  What was assembled is then read back: the
marks say which part a piece belongs to, the same partitions are sorted by the
place in the text that follows from them, and the restored text streams past.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Out of a hundred texts: left as they are; and of the others, those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Units in a piece, and characters in pieces that a task hands on at a time.
UNITS, HELD = 2048, 1 << 22
#: Places of the rows that are no piece: a document's figures come first, its digest last.
HEAD, TAIL = -1, 1 << 62
#: Columns of the pieces, and of the same pieces on their way back.
FIGURES = [("doc", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
PIECES = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("text", pa.string()), *FIGURES])
DIGESTS = pa.schema([*FIGURES, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
NO_FIGURES = (None,) * len(FIGURES)


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers from SHA-256 of seed and doc_id; an absent doc_id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def unit_starts(text: str) -> np.ndarray:
    """Where units begin: runs of A-Z and a-z, and every other character on its own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes | 32) - 97) < 26
    return np.flatnonzero(~(letter & np.r_[False, letter[:-1]])) if len(codes) else np.zeros(0, np.int64)


def arrange(text: str | None, numbers: list[int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, list[tuple[str, int, int]]]:
    """Units of a text, its form, and its output as (mark, first unit, unit after the last)."""
    text = text or ""
    n = len(unit_starts(text))
    if not text or any(mark in text for mark in MARKS) or numbers[2] % 100 >= 100 - plain:
        return n, "plain", [("", 0, n)]
    a, b = sorted(x % (n + 1) for x in numbers[:2])
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, n)
    if numbers[3] % 100 < suffix_first:
        return n, "spm", [suffix, prefix, middle]
    return n, "psm", [prefix, suffix, middle]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def pieces(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The outputs of (doc_id, text, ...) as pieces (row, place, text), and one row of figures a document at place HEAD.

    `row` numbers the documents' rows, so repeated rows are documents of their
    own.  An output is the text of its pieces in the order of `place`.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row, doc, text, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                n, form, parts = arrange(text, numbers, plain, suffix_first)
                at = np.append(unit_starts(text), len(text)).tolist()
                chars = {mark: at[b] - at[a] for mark, a, b in parts}
                rows.append((row, HEAD, None, doc, n, form, chars.get(PREFIX), chars.get(MIDDLE)))
                place = 0
                for mark, a, b in parts:
                    for first in range(a, max(b, a + 1), UNITS):
                        piece = text[at[first]:at[min(first + UNITS, b)]]
                        rows.append((row, place, (mark if first == a else "") + piece, *NO_FIGURES))
                        place, size = place + 1, size + len(piece)
                if size > HELD:
                    yield _batch(rows, PIECES)
                    rows, size = [], 0
        yield _batch(rows, PIECES)

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc"), "text",
                       draws(F.col("doc_id"), seed).alias("numbers"))
    return read.mapInArrow(emit, _ddl(PIECES))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each output as its pieces come by in order, and give each piece the place in the text that its mark tells.

    A mark begins a part, and a part's pieces follow up to the next mark.  No
    other piece can begin with one, as texts that hold marks are plain.
    """
    row, form, part, digest = None, None, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for r, place, text, *figures in zip(*(c.to_pylist() for c in batch.columns)):
            if place == HEAD:
                if row is not None:
                    out.append((row, TAIL, digest.hexdigest(), *NO_FIGURES))
                row, form, part, digest = r, figures[2], 0, hashlib.sha256()
                out.append((r, HEAD, None, *figures))
                continue
            digest.update(text.encode("utf-8", "surrogatepass"))
            if form != "plain" and text[:3] in MARKS:
                part, text = (PREFIX, MIDDLE, SUFFIX).index(text[:3]), text[3:]
            out.append((r, (part << 48) + place, text, *NO_FIGURES))
        yield _batch(out, PIECES)
    if row is not None:
        yield _batch([(row, TAIL, digest.hexdigest(), *NO_FIGURES)], PIECES)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each restored text as its pieces come by in order; one row a document."""
    head, digest = NO_FIGURES, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for _, place, text, *figures in zip(*(c.to_pylist() for c in batch.columns)):
            if place == HEAD:
                head, digest = figures, hashlib.sha256()
            elif place == TAIL:
                out.append((*head, text, digest.hexdigest()))
            else:
                digest.update(text.encode("utf-8", "surrogatepass"))
        yield _batch(out, DIGESTS)


def transform(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Form, lengths and digests of every document's output and of the text restored from it.

    Returns doc_id, n (units), form, prefix_chars and middle_chars (code points;
    NULL if plain), output_sha256 and restored_sha256; further columns are
    dropped.  A NULL text counts as an empty one, which is plain; repeated rows
    stay repeated, an empty table gives an empty one.  The texts are shuffled
    once; both sorts are within partitions and spill, and a document passes its
    task piece by piece, so no text needs to be held whole after the cut.
    """
    dealt = pieces(docs, seed, plain, suffix_first).repartition("row").sortWithinPartitions("row", "place")
    back = dealt.mapInArrow(_assembled, _ddl(PIECES)).sortWithinPartitions("row", "place")
    out = back.mapInArrow(_restored, _ddl(DIGESTS))
    return out.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *(f.name for f in DIGESTS if f.name != "doc"))


def texts(parts: DataFrame) -> DataFrame:
    """(doc_id as text, form, output): the outputs of pieces() joined, for documents that a row may hold."""
    whole = parts.groupBy("row").agg(
        F.max("doc").alias("doc_id"), F.max("form").alias("form"),
        F.sort_array(F.collect_list(F.when(F.col("place") != HEAD, F.struct("place", "text")))).alias("held"))
    return whole.select("doc_id", "form", F.array_join(F.col("held.text"), "").alias("output"))
