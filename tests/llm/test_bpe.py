"""Ids and decoded texts against the library that defines them."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, queries

PATH = queries.vocabulary()
TEXTS = [
    None, "", " ", "  \n", "\n\n a", "à la  à  b", "a   b  c", "x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "!'s don't 12ab",
    "\U0010ffff  \U0010fff0 é\xa0 \xa0  z", "\x1c\x1d a \x1f", "​ 　x", "日本語 テキスト  です。\t\t x\r\n\r\n y", "x'll'll", "word " * 30_000,
]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def test_against_the_library(known):
    rng = random.Random(1)
    letters = list("ab 'sdt\n\t  à\xa0 é😀1²٣_-!\x1c\x85 ̀ſK")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    own = bpe.Encoder(PATH)
    for text, want in zip(texts, known.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert ids.tolist() == want.ids, repr(text[:80])
        assert own.decode(ids.tolist()) == known.decode(want.ids, skip_special_tokens=False)


def test_every_cut_is_certain(known):
    """Each fragment on its own by the library that defines the ids, then concatenated."""
    rng = random.Random(2)
    letters = list("abqz 'sdt\n\t  à\xa0 é😀1²٣_-!.,x\x1c\x85 ̀ſK") + ["'s", "'ll", "'re", " the", "\r\n", "  "]
    own = bpe.Encoder(PATH)
    texts = [t or "" for t in TEXTS if "<|" not in (t or "")] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(6000)]
    for text in texts:
        parts = [x.decode() for x in own.cut([text.encode()])[0].to_pylist()]
        assert "".join(parts) == text
        alone = [i for e in known.encode_batch(parts, add_special_tokens=False) for i in e.ids]
        assert alone == known.encode(text, add_special_tokens=False).ids, repr(text)


def test_short_texts_are_cut():
    """Every pair that no token holds is a cut before white space, whatever the length."""
    own = bpe.Encoder(PATH)
    held = {pair for token in own.ids for pair in zip(token, token[1:])}
    for text in ("One small step, (for) a man.", "a b", "x = y1;"):
        data = text.encode()
        sure = sum((a, b) not in held for a, b in zip(data, data[1:]) if b == 32)
        assert len(own.cut([data])[0]) > sure >= text.count(" ") > 0
    parts, counts = own.cut([b"One step", b"", b" on"])
    assert parts.to_pylist() == [b"One", b" step", b" on"] and counts.tolist() == [2, 0, 1]


def test_texts_do_not_meet(known):
    texts = ["a <|endof", "text|> b", None, "<|endoftext|>", "", "x<|endoftext|>y <|endoftext|>"]
    own = bpe.Encoder(PATH)
    assert [x.tolist() for x in own.encode_all(texts)] == [known.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded(known, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    own = bpe.Encoder(PATH)
    text = " ".join(f"word{i} qz{i}" for i in range(300))
    assert own.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids and len(own.known) <= 10


def test_columns(spark, known):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = df.select("doc_id", "text", bpe.encode(F.col("text"), PATH).alias("ids"))
    for row in ids.select("*", bpe.decode(F.col("ids"), PATH).alias("back")).collect():
        assert list(row.ids) == known.encode(row.text or "", add_special_tokens=False).ids
        assert row.back == (row.text or "")


def test_bytes_that_are_no_text(spark, known):
    cut = known.encode("é").ids[:1] if len(known.encode("é").ids) > 1 else [known.token_to_id("Ã")]
    df = spark.createDataFrame([(cut,), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.decode(F.col("ids"), PATH)).collect()] == [known.decode(cut), ""]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "text string")
    assert empty.select(bpe.encode(F.col("text"), PATH)).count() == 0
