"""Byte-pair encoding and decoding with forced boundaries.

Merges only ever join bytes into pieces of vocabulary tokens.  A pair of
neighbouring bytes that no token holds is therefore a certain cut: what stands
left and right of it can be encoded on its own and the ids concatenated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts and bytes that a task encodes at a time; fragments whose ids it remembers, and their most bytes.
ROWS, CHUNK, MEMO, MEMO_BYTES = 500, 1 << 21, 100_000, 32
#: How byte-level vocabularies split text before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The tokens of a vocabulary file, as bytes by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.letters = byte_letters()
        self.ids = {self.raw(token): i for token, i in self.spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def raw(self, token: str) -> bytes:
        return bytes(map(self.letters.__getitem__, token))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _kind(byte: int) -> str:
    """How the splitting pattern sees the character that a byte begins or is; a later byte of a character has no kind."""
    c = chr(byte)
    if byte >= 128:
        return "wide" if byte >= 192 else ""
    return "blank" if c in "\t\n\v\f\r " else "letter" if c.isalpha() else "digit" if c.isdigit() else "sign"


def certain_cuts(tokens: Iterable[bytes]) -> np.ndarray:
    """A table of 256 x 256: may a text be cut between these two bytes?

    No token holds the pair, and splitting the text before merging gives the same
    pieces on either side, or pieces that the pair alone keeps apart:
    white space on the right never belongs to the piece on the left; signs,
    digits and letters either stand in one run of their kind or in two.  An
    apostrophe may open a contraction, which depends on what stands before it
    and takes what stands behind it, and white space on the left is read with
    what follows, so there is no such cut beside them.
    """
    held = np.zeros((256, 256), bool)
    for token in tokens:
        held[np.frombuffer(token, np.uint8)[:-1], np.frombuffer(token, np.uint8)[1:]] = True
    kinds = [_kind(b) for b in range(256)]
    allowed = np.zeros((256, 256), bool)
    for a in range(256):
        for b in range(256):
            left, right = kinds[a], kinds[b]
            if right == "blank":
                allowed[a, b] = True
            elif left in ("letter", "digit", "sign") and right:
                allowed[a, b] = a != ord("'") and (b != ord("'") or left != "sign")
    return allowed & ~held


class Encoder(Vocabulary):
    """Merges each fragment between certain cuts on its own."""

    def __init__(self, path: str):
        super().__init__(path)
        self.cuts = certain_cuts(self.ids).ravel()
        order = [bytes([b]) for b in range(256)]
        for merge in self.spec["model"]["merges"]:
            order.append(b"".join(map(self.raw, merge if isinstance(merge, list) else merge.split(" "))))
        self.by_rank = [self.ids[token] for token in order]
        self.model = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.specials = re.compile(b"|".join(re.escape(x.encode()) for x in self.special)) if self.special else None
        self.whole = {x.encode(): [i] for x, i in self.special.items()}
        self.known: dict[bytes, list[int]] = {}
        del self.spec

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All fragments of some texts, one after the other, and how many each text has."""
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer(data, np.uint8).astype(np.int32)
        here = np.zeros(len(data) + 1, bool)
        here[1:-1] = self.cuts[codes[:-1] * 256 + codes[1:]]
        if self.specials:  # each is a fragment of its own
            for text, end in zip(texts, ends.tolist()):
                for m in self.specials.finditer(text):
                    a, b = m.start() + end - len(text), m.end() + end - len(text)
                    here[a + 1:b] = False
                    here[[a, b]] = True
        here[0] = True
        here[ends] = True
        at = np.flatnonzero(here)
        counts = np.diff(np.searchsorted(at, np.r_[0, ends]))
        parts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(data)])
        return parts, counts

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment; those of short ones are remembered until there are MEMO of them."""
        if fragment in self.whole:
            return self.whole[fragment]
        by_rank = self.by_rank
        ids = [by_rank[i] for i in self.model.encode_ordinary(fragment.decode())]
        if len(fragment) <= MEMO_BYTES:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[fragment] = ids
        return ids

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; every different fragment is merged once a chunk of texts."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append((text or "").encode())
            size += len(held[-1])
            if len(held) >= ROWS or size >= CHUNK:
                yield from self._encoded(held)
                held, size = [], 0
        if held:
            yield from self._encoded(held)

    def _encoded(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not any(texts):
            yield from (np.zeros(0, "<i4") for _ in texts)
            return
        parts, counts = self.cut(texts)
        coded = parts.dictionary_encode()
        get, merged = self.known.get, self.merged
        ids = [get(x) or merged(x) for x in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.fromiter(chain.from_iterable(ids), "<i4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        sizes, ends = sizes[which], np.cumsum(sizes[which])
        out = flat[np.repeat(starts[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        last = np.r_[0, ends][np.cumsum(counts)]
        yield from np.split(out, last[:-1])

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """Token ids of a text under a byte-level vocabulary file that every executor can open.

    NULL and empty texts have no ids.  Special tokens spelled out in a text get
    their own id.  `path` is a parameter of the job: the file is not part of it.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            found = own.encode_all(texts)
            for at in range(0, len(texts), ROWS):
                yield pd.Series(list(islice(found, ROWS)), dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; bytes that are no UTF-8 become replacement characters, NULL ids the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = vocabulary(path)
        for lists in batches:
            for at in range(0, len(lists), ROWS):
                yield pd.Series(["" if x is None else own.decode(x.tolist()) for x in lists[at:at + ROWS]], dtype=object)

    return run(ids)
