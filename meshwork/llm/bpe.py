"""BPE encoding and decoding with a published word-level vocabulary.

Method: contiguous rank array.  A short word is held as a row of parts with the
rank of every adjacent pair beside it; the smallest rank is found by a scan, its
boundary deleted, and the two neighbouring ranks refreshed.  Words of about the
same length are worked on together, as the rows of one numpy array each.  Words
of more than ``SHORT`` parts keep the same order in a heap, so that one word of
a megabyte does not take quadratic time.

White space ends every token of this vocabulary, and canonical composition
never crosses it; so a text is encoded word by word, and a task remembers the
words it has met, up to about ``REMEMBER`` bytes of them (then it starts anew).
The memory ends with the task.  Rows leave in pieces of about a megabyte of text.

Nulls: a null text is empty; an empty text has no tokens.  Every other column
is carried or dropped as the caller selects.  Rows are independent: repeated
rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import column, lean, load, map_arrow, pieces

SHORT = 128
REMEMBER = 48_000_000
CELLS = 400_000  # places of the arrays that words are merged in
WIDTH = 20  # bits of an id
ROWS = 256  # rows that are decoded at once
FILE = "word_bpe_49k.json"

#: Unicode white space, as the vocabulary's normaliser sees it.
_BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: str.split() also splits at these, which aren't white space to the normaliser.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself,
    the others follow from U+0100 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(shifted)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: The rank of a pair of ids, and the id that each rank makes.
        self.rank = {self.vocab[a] << WIDTH | self.vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.into = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = regex.compile(split["pattern"]["Regex"])
        alphabet = _byte_alphabet()
        self._inner = [self.vocab[c] for c in alphabet]
        self._last = [self.vocab[c + self.end] for c in alphabet]
        order = np.argsort(keys := np.array(list(self.rank), np.int64))
        self._keys, self._ranks = keys[order], np.array(list(self.rank.values()), np.int32)[order]
        self._far, self._made = np.int32(len(self.into)), np.array([*self.into, -1], np.int32)
        self._bytes, self._ends = np.array(self._inner, np.int32), np.array(self._last, np.int32)
        every = np.repeat(self._bytes, 256)
        #: Ranks of two bytes, within a word and at its end.
        self._first = self._lookup(every, np.tile(self._bytes, 256)).reshape(256, 256), self._lookup(every, np.tile(self._ends, 256)).reshape(256, 256)
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words."""
        self._packed: dict[str, bytes] = {}
        self._said: dict[str, tuple[str, str]] = {}
        self._room = REMEMBER

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; beyond all ranks for those that don't merge."""
        key = a.astype(np.int64) << WIDTH | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], self._far)

    def merge_rows(self, pieces_: list[bytes], width: int) -> list[bytes]:
        """Ids (packed as 32-bit integers) of pieces of at most ``width`` bytes."""
        n, cols = len(pieces_), np.arange(width)
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces_]), np.uint8).reshape(n, width)
        size = np.array(list(map(len, pieces_)))
        every, live = np.arange(n), np.arange(n)
        parts = np.where(cols < size[:, None], self._bytes[raw], np.int32(-1))
        parts[every, size - 1] = self._ends[raw[every, size - 1]]
        ranks = np.full((n, width), self._far, np.int32)
        inner, last = self._first
        ranks[:, :-1] = np.where(cols[1:] < size[:, None] - 1, inner[raw[:, :-1], raw[:, 1:]], self._far)
        two = np.flatnonzero(size > 1)
        ranks[two, size[two] - 2] = last[raw[two, size[two] - 2], raw[two, size[two] - 1]]
        done, left = np.empty((n, width), np.int32), size.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            low = ranks[row, at]
            more = low < self._far
            if not more.all():
                done[live[~more]] = parts[~more]
                live, parts, ranks, at, low = live[more], parts[more], ranks[more], at[more], low[more]
                row = row[: len(live)]
                if not len(live):
                    break
            left[live] -= 1
            # the boundary goes: what lies beyond moves up
            beyond = cols[:-1] > at[:, None]
            parts[:, :-1] = np.where(beyond, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(beyond | (cols[:-1] == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            parts[:, -1], ranks[:, -1] = -1, self._far
            new = self._made[low]
            parts[row, at] = new
            after = np.where(at + 1 < width, parts[row, np.minimum(at + 1, width - 1)], -1)
            ranks[row, at] = self._lookup(new, after)
            k = np.flatnonzero(at)
            ranks[k, at[k] - 1] = self._lookup(parts[k, at[k] - 1], new[k])
        upto = np.concatenate([[0], np.cumsum(left)]) * 4
        flat = done[cols < left[:, None]].tobytes()
        return [flat[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def merge_all(self, pieces_: list[bytes]) -> list[bytes]:
        """Ids of many pieces, those of about the same length together."""
        out: list[bytes] = [b""] * len(pieces_)
        size, low = np.array(list(map(len, pieces_)), np.int64), 0
        width = 8
        while low < SHORT:
            some = np.flatnonzero((size > low) & (size <= width))
            for a in range(0, len(some), max(1, CELLS // width)):
                rows = some[a : a + max(1, CELLS // width)].tolist()
                for k, ids in zip(rows, self.merge_rows([pieces_[k] for k in rows], width), strict=True):
                    out[k] = ids
            low, width = width, 2 * width
        for k in np.flatnonzero(size > SHORT).tolist():
            x = pieces_[k]
            out[k] = array("i", self._merge_long([*map(self._inner.__getitem__, x[:-1]), self._last[x[-1]]])).tobytes()
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k, p) for k in range(n - 1) if (p := parts[k] << WIDTH | parts[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            low, k, pair = heapq.heappop(heap)
            if parts[k] < 0 or (j := after[k]) >= n or parts[k] << WIDTH | parts[j] != pair:
                continue
            parts[k], parts[j] = self.into[low], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) < n and (p := parts[left] << WIDTH | parts[right]) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
        return [x for x in parts if x >= 0]

    def _split_word(self, word: str) -> str | list[str]:
        """The piece, or pieces, of one run of characters without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        return word if word.isalpha() else self._split.findall(word)

    def learn(self, words: list[str]) -> list[bytes]:
        """Packed ids of words."""
        split = list(map(self._split_word, words))
        every = {x for x in split if isinstance(x, str)}.union(*(x for x in split if not isinstance(x, str)))
        every = list(every)
        ids = dict(zip(every, self.merge_all([x.encode() for x in every]), strict=True))
        return [ids[x] if isinstance(x, str) else b"".join([ids[y] for y in x]) for x in split]

    def meet(self, parts: list[list[str | list[str]]], memory: dict, make=None) -> None:
        """Puts all words of some texts into a memory; if it is full, it is
        emptied first of what these texts do not need."""
        need = set().union(*(part for text in parts for part in text if not isinstance(part, str)))
        new = list(need.difference(memory))
        if new:
            learnt = self.learn(new)
            # a word's objects and its place in the dictionary
            self._room -= sum(map(len, new)) + (150 if make is None else 350) * len(new)
            if self._room < 0:
                for w in [w for w in memory if w not in need]:
                    del memory[w]
                self._room = REMEMBER - (160 if make is None else 360) * len(need)
            memory.update(zip(new, learnt if make is None else map(make, learnt), strict=True))

    def _parts(self, text: str) -> Iterator[str | list[str]]:
        """A text's special tokens (str) and the words between (lists)."""
        for part in self._special.split(text) if self._special and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield part
            else:
                yield [w for w in _BLANKS.split(part) if w] if _SEPARATORS.search(part) else part.split()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as 32-bit integers."""
        parts = [list(self._parts(x)) for x in texts]
        self.meet(parts, known := self._packed)
        one = {k: array("i", [v]).tobytes() for k, v in self.special.items()}
        return [b"".join([x for part in text for x in ([one[part]] if isinstance(part, str) else map(known.__getitem__, part))]) for text in parts]

    def _say(self, packed: bytes) -> tuple[str, str]:
        ids = array("i", packed)
        return " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def both(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids and tokens of texts, each joined by one space."""
        parts = [list(self._parts(x)) for x in texts]
        self.meet(parts, known := self._said, self._say)
        for text in parts:
            out = [x for part in text for x in ([(str(self.special[part]), part)] if isinstance(part, str) else map(known.__getitem__, part))]
            yield " ".join([x for x, _ in out if x]), " ".join([y for x, y in out if x])

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.packed([text or ""])[0]))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: tokens joined by one space."""
        return " ".join(self.token[i] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec(text: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file (under 2 MB, whatever the input) for all executors."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(col: pa.Array) -> Iterator[tuple[int, int, Iterator[str]]]:
    """Runs of rows of about a megabyte, with their texts; null is empty."""
    for start, end, _, _ in pieces(col):
        yield start, end, (x.as_py() or "" for x in col.slice(start, end - start))


def encode(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``ids`` (array of int): the whole text's
    tokens.  An existing column ``ids`` is replaced."""
    vocab = _vocabulary(df, path)
    keep = [f for f in df.schema.fields if f.name not in (text, "ids")]
    schema = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value)
        for b in batches:
            for start, end, some in _texts(column(b, text)):
                got = c.packed(list(some))
                upto = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.frombuffer(b"".join(got), np.int32)))
                yield pa.RecordBatch.from_arrays([*(column(b, f.name).slice(start, end - start) for f in keep), ids], names=[*(f.name for f in keep), "ids"])
        c.forget()

    return map_arrow(df, run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` without ``ids``, with the decoded ``text``; null ids are none."""
    vocab = _vocabulary(df, path)
    keep = [f for f in df.schema.fields if f.name not in (ids, "text")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType(), False)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value)
        for b in batches:
            some = column(b, ids)
            for start in range(0, len(some), ROWS):
                said = pa.array([c.decode(x.as_py() or []) for x in some.slice(start, ROWS)], pa.string())
                yield pa.RecordBatch.from_arrays([*(column(b, f.name).slice(start, ROWS) for f in keep), said], names=[*(f.name for f in keep), "text"])

    return map_arrow(df, run, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, made
    in one pass without writing the ids out."""
    vocab = _vocabulary(df, path)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value)
        for b in batches:
            for start, end, some in _texts(column(b, "text")):
                count, ids_sha, said_sha = [], [], []
                for ids, said in c.both(list(some)):
                    count.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    said_sha.append(hashlib.sha256(said.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").slice(start, end - start), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(said_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir))
