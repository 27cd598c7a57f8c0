import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from meshwork.llm import bpe

from .helpers import empty, table

TEXTS = [
    "", None, "  ", "Hello World, it's 2024!", "Σας ΟΔΥΣΣΕΥΣ", "a<|endoftext|>b <|startoftext|>", "İstanbul ǅ", "éà ẛ̣", "x\x1cy \x1f z\x85w\xa0v u᠎q​p",
    "it's I'LL 'S don'tt '' 12345 ½ ²", "日本語テスト 👩‍👩‍👧 \x00\x01", "a" * 5000, "<|endoftext|", "﻿abc", "が が ﬁ Å", "ab" * 300 + "'s", "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_as_the_library(spark, library):
    got = {r["doc_id"]: r for r in bpe.digests(table(spark, TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert got[k]["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text


def test_encode_and_decode(spark, library):
    encoded = bpe.encode(table(spark, TEXTS))
    assert "extra" in encoded.columns and "text" not in encoded.columns
    for r in bpe.decode(encoded).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["text"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty(spark)).count() == 0


def test_long_words_merge_alike():
    """Rows of arrays and the heap, and words at the arrays' widths."""
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    words = ["abcabcabc" * 9, "onntlyedtheinth" * 7, "zzzzzzzzzzzzzz" * 5, *("interrogations"[:k] for k in range(1, 15)), "a" * 16, "é" * 8, "the" * 11]
    want = [c._merge_long([*(c._inner[b] for b in w.encode()[:-1]), c._last[w.encode()[-1]]]) for w in words]
    assert [np.frombuffer(x, np.int32).tolist() for x in c.merge_all([w.encode() for w in words])] == want
    assert c.merge_all([]) == []


def test_memory_is_bounded(library, monkeypatch):
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    monkeypatch.setattr(bpe, "REMEMBER", 20_000)
    c.forget()
    for k in range(0, 3000, 100):
        texts = [f"word{j} again" for j in range(k, k + 100)]
        assert [np.frombuffer(x, np.int32).tolist() for x in c.packed(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(c._packed) <= 250
