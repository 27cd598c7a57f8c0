"""Encoding, spans and decoding against the library."""

import hashlib
import random
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest

from meshwork.llm import sentencepiece as M

from .helpers import empty, table

sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    with open(M.model_path(), "rb") as f:
        data = f.read()
    return M.Model(data), sp.SentencePieceProcessor(model_proto=data), data


ODD = ["", " ", "  a  b ", "a\tb\nc", "x▁y", "▁▁x", "hé日本𝒳", "<s>", "<0x41> </s>", "\x00a", " \n", "ﬁ①", "    " * 50 + "x", "a" * 500, "日本語" * 100, "�", "x" * 129 + " " * 200 + "𝒳" * 3, "é"]


def _texts(rnd, n):
    return ["".join(rnd.choice(" ▁abtheé日𝒳\n.,01ﬁ①Ａ") for _ in range(rnd.randrange(200))) for _ in range(n)]


def _proto(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_equals_the_library(both):
    own, library, _ = both
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text in [*ODD, *_texts(random.Random(5), 200), *real]:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
        assert own.encode_spans(text) == _proto(library, text)


def test_any_ids_decode_as_in_the_library(both):
    own, library, _ = both
    rnd = random.Random(1)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32000), rnd.randrange(3), 28705, 259]) for _ in range(rnd.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(n, data):
    return _varint(n << 3 | 2) + _varint(len(data)) + data


def _with(data, charsmap, prefix=1, squeeze=1, fallback=True):
    """The model file with another normaliser (and without byte pieces)."""
    out, drop = b"", set()
    for n, value in M._fields(data):
        if n == 3:
            out += _message(3, _message(1, b"own") + (_message(2, charsmap) if charsmap else b"") + b"".join(_varint(k << 3) + _varint(v) for k, v in ((3, prefix), (4, squeeze), (5, 1))))
        elif n == 2 and not fallback:
            out += _message(2, b"".join(_message(k, v) if isinstance(v, bytes) and k not in (10, 15, 51) else _varint(k << 3 | 5) + v if isinstance(v, bytes) else _varint(k << 3) + _varint(v) for k, v in M._fields(value) if k != 35))
        elif n == 1 and not fallback and b"<0x" in value:
            drop.add(value)
        else:
            out += _message(n, value)
    return out


def _library_map():
    normaliser = sp.SentencePieceNormalizer(rule_name="nmt_nfkc")
    for n, value in M._fields(normaliser.serialized_model_proto()):
        if n == 3:
            return dict(M._fields(value)).get(2, b"")
    return b""


@pytest.mark.parametrize("prefix,squeeze", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_character_maps_keep_offsets(both, prefix, squeeze):
    """A published compiled map (NFKC) put into the model: longest prefixes,
    removed blanks, and every span's source bytes."""
    charsmap = _library_map()
    assert len(charsmap) > 1000
    data = _with(both[2], charsmap, prefix, squeeze)
    own, library = M.Model(data), sp.SentencePieceProcessor(model_proto=data)
    for text in [*ODD, "  ﬁ  ①Ａ　é ½ ", "㍿ ㎏", "​ a ­", *_texts(random.Random(2), 150)]:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text
        assert own.encode_spans(text) == _proto(library, text), text


def test_without_byte_fallback(both):
    data = _with(both[2], b"", 1, 0, fallback=False)
    own, library = M.Model(data), sp.SentencePieceProcessor(model_proto=data)
    for text in [*ODD, *_texts(random.Random(3), 100)]:
        assert own.encode(text, ends=False) == library.encode(text), text
        assert own.encode_spans(text) == _proto(library, text), text


def test_other_models_are_refused(both):
    with pytest.raises(ValueError):
        M.Model(_message(1, _message(1, b"a") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0)) + _message(2, _varint(3 << 3) + _varint(1)))


def test_memory_that_is_full_or_has_the_hash(both, monkeypatch):
    own, library, data = both
    texts = ["the quick brown fox", "jumps over", "the lazy dogs 日本𝒳", "aé" * 40]
    raw = [t.encode() for t in texts]
    args = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [library.encode(t) for t in texts]
    got = lambda m: (lambda r: [r[0][a:b].tolist() for a, b in zip(r[1], r[1][1:], strict=False)])(m.encoded(*args))
    monkeypatch.setattr(M, "REMEMBER", 100)
    small = M.Model(data)
    assert got(small) == want and got(small) == want
    monkeypatch.setattr(M, "_hashes", lambda codes, begin, size: np.full(len(begin), 7, np.uint64))
    same = M.Model(data)
    assert got(same) == want and got(same) == want


def test_frames(spark, both):
    own, library, _ = both
    texts = [None, "", "Hello  world.", "日本𝒳", "Hello  world.", "word " * 20_000]
    df = table(spark, texts).withColumnRenamed("extra", "a.b").withColumnRenamed("n_chars", "ids")
    enc = M.encode(df)
    assert enc.columns == ["doc_id", "lang", "source", "a.b", "ids", "begins", "ends"]
    for r in enc.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text, add_bos=True, add_eos=True)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == data
    assert {r["doc_id"]: r["text"] for r in M.decode(enc).collect()} == {k: t or "" for k, t in enumerate(texts)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in M.digests(df).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))
    assert M.digests(empty(spark)).count() == 0 and M.encode(empty(spark)).count() == 0
