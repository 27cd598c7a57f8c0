"""SentencePiece encoding with byte offsets, and decoding.

Method: offset-preserving encoding.  A text is normalised by the longest prefix
that the model's compiled character map knows at each place (a double array
over UTF-8 bytes); beside every normalised byte stands the offset of its source
character.  Pieces are merged on the normalised text, and each piece's span in
the original bytes is read off that alignment at its two ends.  A character
without a piece falls back to its bytes: the last of them has the character's
span, the others are empty at its start.

Merges are greedy by score, the leftmost of equal ones first.  A text is cut
where two characters meet that no piece has side by side (no merge crosses such
a place), and a task remembers the parts it has met, up to about ``REMEMBER``
bytes.  Parts of about one length are merged together as rows of numpy arrays,
those of more than ``SHORT`` characters with a heap, so that a megabyte without
such a place takes no quadratic time.

Models: BPE, with or without character map, dummy prefix, removal of extra
blanks and byte fallback.  Others (unigram, user-defined or unused pieces,
blanks as suffixes) raise ``ValueError``.

Nulls: a null text is empty; it has only the begin and end ids that are asked
for, and decodes to an empty text.  Rows are independent: repeated rows give
repeated results, and an empty table gives none.  ``encode`` carries all other
columns under any name; existing columns ``ids``, ``begins`` and ``ends`` are
replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import column, lean, load, map_arrow, mix64, pieces

SHORT = 128
REMEMBER = 48_000_000
CELLS = 400_000  # places of the arrays that parts are merged in
ROWS = 256  # rows that are decoded at once
FILE = "piece_bpe_32k.model"

BLANK = "▁"
#: Fixed values of the model format: kinds of pieces, and what stands for an unknown one.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SURFACE = " ⁇ "
BPE = 2
_FAR = np.int32(np.iinfo(np.int32).max)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at ``begin``, one after another."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _hashes(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each run of code points."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    if int(size.sum()) != len(codes):
        codes, begin = codes[_ranges(begin, size)], np.cumsum(size) - size
    place = (np.arange(len(codes)) - np.repeat(begin, size)).astype(np.uint64)
    value = mix64(codes.astype(np.uint64) * _MULTIPLIER + place)
    return mix64(np.add.reduceat(value, begin) + size.astype(np.uint64))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double array whose leaves hold offsets of
    replacements in a block of zero-terminated strings."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.strings = data[4 + size :]
        #: Bytes that begin no key: the usual text is passed over by these.
        self.starts = {b for b in range(256) if self._child(0, b) is not None} if data else set()

    def _child(self, at: int, byte: int) -> int | None:
        unit = self.units[at]
        to = at ^ (unit >> 10) << ((unit & 1 << 9) >> 6) ^ byte
        return to if to < len(self.units) and self.units[to] & (1 << 31 | 0xFF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a place and its replacement."""
        found, node, k = None, 0, at
        while k < len(data) and (node := self._child(node, data[k])) is not None:
            k += 1
            if self.units[node] >> 8 & 1:
                unit = self.units[node]
                leaf = self.units[node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)]
                found = k - at, leaf & (1 << 31) - 1
        if found is None:
            return None
        size, begin = found
        return size, self.strings[begin : self.strings.index(b"\0", begin)]


class Model:
    """Encoder and decoder of one model file (its bytes)."""

    def __init__(self, data: bytes):
        every, trainer, normaliser = [], {}, {}
        for n, value in _fields(data):
            if n == 1:
                every.append(dict(_fields(value)))
            elif n in (2, 3):
                (trainer if n == 2 else normaliser).update(_fields(value))
        names = [p[1].decode() for p in every]
        kinds = [p.get(3, NORMAL) for p in every]
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models of normal, unknown, control and byte pieces are read")
        self.names, self.kinds, self.fallback = names, np.array(kinds), bool(trainer.get(35, 0))
        self.unknown, self.begin, self.end = kinds.index(UNKNOWN), trainer.get(41, 1), trainer.get(42, 2)
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.bytes_ = np.full(256, -1, np.int64)
        for k in np.flatnonzero(self.kinds == BYTE).tolist():
            self.bytes_[int(names[k][3:-1], 16)] = k
        scores = {names[k]: (struct.unpack("<f", every[k][2])[0] if 2 in every[k] else 0.0, k) for k in range(len(names)) if kinds[k] == NORMAL}
        self._merges(scores)
        self._surfaces()
        self.forget()

    # tables

    def _merges(self, scores: dict[str, tuple[float, int]]) -> None:
        """Symbols are the normal pieces by id and, beyond them, single
        characters that pieces contain without being pieces themselves."""
        symbol = {w: k for w, (_, k) in scores.items()}
        chars = sorted({c for w in symbol for c in w})
        for c in chars:
            symbol.setdefault(c, len(self.names) + len(symbol))
        order = {s: k for k, s in enumerate(sorted({s for s, _ in scores.values()}, reverse=True))}
        pairs = {(symbol[w[:k]], symbol[w[k:]]): (order[s], i) for w, (s, i) in scores.items() for k in range(1, len(w)) if w[:k] in symbol and w[k:] in symbol}
        self._pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self._keys, (self._ranks, self._made) = keys[by], (np.array(list(pairs.values()), np.int32).reshape(-1, 2)[by].T.copy())
        #: The class of each code point (0: in no piece), and which classes meet in a piece.
        self._class = np.zeros(0x110000, np.uint16)
        self._class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        place = {c: k + 1 for k, c in enumerate(chars)}
        self._meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        met = np.array(list({(place[a], place[b]) for w in scores for a, b in zip(w, w[1:], strict=False)}) or [(0, 0)])
        self._meet[met[:, 0], met[:, 1]] = len(scores) > 0
        self._meet[0, 0] = False
        self._symbols = np.full(len(chars) + 1, -1, np.int32)
        self._symbols[1:] = [symbol[c] for c in chars]

    def _surfaces(self) -> None:
        """What each id decodes to, as one block of bytes."""
        said = []
        for name, kind in zip(self.names, self.kinds.tolist(), strict=True):
            byte = bytes([int(name[3:-1], 16)]) if kind == BYTE else b""
            said.append(byte or {CONTROL: b"", UNKNOWN: UNKNOWN_SURFACE.encode()}.get(kind, name.replace(BLANK, " ").encode()))
        self.chars = np.array([len(x) for x in self.names], np.int32)
        self._said = np.frombuffer(b"".join(said), np.uint8)
        self._upto = np.cumsum([0, *map(len, said)])

    def forget(self) -> None:
        """Empties the memory of parts."""
        self._hash, self._slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._codes, self._codes_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._ids, self._size, self._ids_at = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    # normalisation

    def normalised(self, text: str) -> tuple[str, list[int]]:
        """The text that pieces are looked for in, and for each of its characters
        the byte offset of its source; one more offset for the end."""
        data, blank = text.encode(), BLANK if self.escape else " "
        out: list[str] = []
        align: list[int] = []
        at = 0
        while at < len(data):
            size, new = self._step(data, at)
            for c in new.decode():
                if c == " " and self.squeeze and (not out or out[-1] == blank):
                    continue
                out.append(blank if c == " " else c)
                align.append(at)
            at += size
        if self.squeeze:
            while out and out[-1] == blank:
                out.pop()
                at = align.pop()
        if out and self.prefix:
            out.insert(0, blank)
            align.insert(0, align[0])
        return "".join(out), [*align, at]

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes used at a place, and what stands for them."""
        if data[at] in self.map.starts and (found := self.map.longest(data, at)):
            return found
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return size, data[at : at + size]

    def _normal(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised code points of texts (UTF-8 bytes and offsets), the texts'
        offsets into these, and the source byte of every character and, after
        each text, its end.  Without a map this is one pass over arrays."""
        if self.map.units or self.squeeze:
            raw = data.tobytes()
            some = [self.normalised(raw[a:b].decode()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            codes = np.frombuffer("".join([x for x, _ in some]).encode("utf-32-le"), np.uint32)
            return codes, np.cumsum([0, *(len(x) for x, _ in some)]), np.array(list(chain.from_iterable(x for _, x in some)), np.int64)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if self.escape:
            codes = np.where(codes == 0x20, np.uint32(ord(BLANK)), codes)
        begin = np.flatnonzero(data & 0xC0 != 0x80)
        upto = np.searchsorted(begin, offs)
        begin = begin - np.repeat(offs[:-1], np.diff(upto))
        lead = upto[:-1][np.diff(upto) > 0] if self.prefix else upto[:0]
        added = np.concatenate([[0], np.cumsum((np.diff(upto) > 0) & self.prefix)])
        # where a text ends and the next begins, the end comes first
        begin = np.insert(begin, np.concatenate([upto[1:], lead]), np.concatenate([np.diff(offs), np.zeros(len(lead), np.int64)]))
        return np.insert(codes, lead, np.uint32(ord(BLANK if self.escape else " "))), upto + added, begin

    # merges

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols (``_FAR``: they don't merge) and what they make."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], _FAR), self._made[at]

    def _merge_rows(self, codes: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of parts of at most ``width`` characters, and how many each
        has; -1 for a character of no piece."""
        n, cols = len(size), np.arange(width)
        parts = np.full((n, width), -2, np.int32)
        parts[cols < size[:, None]] = self._symbols[self._class[codes]]
        ranks, into = np.full((n, width), _FAR, np.int32), np.zeros((n, width), np.int32)
        ranks[:, :-1], into[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        done, left, live = np.empty((n, width), np.int32), size.copy(), np.arange(n)
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            more = ranks[row, at] < _FAR
            if not more.all():
                done[live[~more]] = parts[~more]
                live, parts, ranks, into, at = live[more], parts[more], ranks[more], into[more], at[more]
                row = row[: len(live)]
                if not len(live):
                    break
            left[live] -= 1
            new = into[row, at]
            # the boundary goes: what lies beyond moves up
            beyond = cols[:-1] > at[:, None]
            shift = beyond | (cols[:-1] == at[:, None])
            parts[:, :-1] = np.where(beyond, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1], into[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1]), np.where(shift, into[:, 1:], into[:, :-1])
            parts[:, -1], ranks[:, -1] = -2, _FAR
            parts[row, at] = new
            after = np.where(at + 1 < width, parts[row, np.minimum(at + 1, width - 1)], -2)
            ranks[row, at], into[row, at] = self._rank(new, after)
            k = np.flatnonzero(at)
            ranks[k, at[k] - 1], into[k, at[k] - 1] = self._rank(parts[k, at[k] - 1], new[k])
        return done[cols < left[:, None]], left

    def _merge_long(self, codes: np.ndarray) -> list[int]:
        """The same order of merges by a heap of (rank, place)."""
        parts = self._symbols[self._class[codes]].tolist()
        n, pairs = len(parts), self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, parts[k], parts[k + 1]) for k in range(n - 1) if (found := pairs.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if parts[k] != a or (j := after[k]) >= n or parts[j] != b:
                continue
            parts[k], parts[j] = pairs[a, b][1], -2
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) < n and (found := pairs.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (found[0], x, parts[x], parts[y]))
        return [p for p in parts if p != -2]

    def _spelt(self, codes: np.ndarray, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """Ids and characters of a part with symbols that are no pieces: these
        become unknown or their bytes, of which the last has the character."""
        ids, sizes, at = [], [], 0
        for k in symbols.tolist():
            if 0 <= k < len(self.names):
                ids.append(k)
                sizes.append(len(self.names[k]))
            elif self.fallback:
                data = chr(codes[at]).encode()
                ids += self.bytes_[list(data)].tolist()
                sizes += [0] * (len(data) - 1) + [1]
            else:
                ids.append(self.unknown)
                sizes.append(1)
            at += len(self.names[k]) if 0 <= k < len(self.names) else 1
        return ids, sizes

    def _learn(self, codes: np.ndarray, upto: np.ndarray) -> None:
        """Adds parts (code points and offsets) to the memory."""
        size = np.diff(upto)
        symbols: list[np.ndarray] = []
        count, order, low, width = np.zeros(len(size), np.int64), [], 0, 4
        while low < SHORT:
            some = np.flatnonzero((size > low) & (size <= width))
            for a in range(0, len(some), max(1, CELLS // width)):
                rows = some[a : a + max(1, CELLS // width)]
                got, count[rows] = self._merge_rows(codes[_ranges(upto[rows], size[rows])], size[rows], width)
                symbols.append(got)
                order.append(rows)
            low, width = width, 2 * width
        for k in np.flatnonzero(size > SHORT).tolist():
            got = np.array(self._merge_long(codes[upto[k] : upto[k + 1]]), np.int32)
            count[k] = len(got)
            symbols.append(got)
            order.append(np.array([k]))
        # as learnt, parts lie by width: the memory keeps them in that order
        by = np.concatenate(order)
        flat, count, size, from_ = np.concatenate(symbols), count[by], size[by], upto[by]
        sizes = self.chars[np.clip(flat, 0, len(self.names) - 1)]
        odd = (flat < 0) | (flat >= len(self.names))
        if odd.any():
            ends = np.cumsum(count)
            ids_, sizes_, was = [], [], 0
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
                first = int(ends[k] - count[k])
                a, b = self._spelt(codes[from_[k] : from_[k] + size[k]], flat[first : ends[k]])
                ids_ += [flat[was:first], a]
                sizes_ += [sizes[was:first], b]
                was, count[k] = int(ends[k]), len(a)
            flat, sizes = np.concatenate([*ids_, flat[was:]]), np.concatenate([*sizes_, sizes[was:]])
        own = codes[_ranges(from_, size)]
        at = np.concatenate([[0], np.cumsum(size)])
        hashes, slots = _hashes(own, at[:-1], size), np.arange(len(by)) + len(self._codes_at) - 1
        self._codes, self._codes_at = np.concatenate([self._codes, own]), np.concatenate([self._codes_at, self._codes_at[-1] + at[1:]])
        self._ids, self._size = np.concatenate([self._ids, flat.astype(np.int32)]), np.concatenate([self._size, sizes.astype(np.int32)])
        self._ids_at = np.concatenate([self._ids_at, self._ids_at[-1] + np.cumsum(count)])
        hashes, slots = np.concatenate([self._hash, hashes]), np.concatenate([self._slot, slots])
        order = np.argsort(hashes, kind="stable")
        self._hash, self._slot = hashes[order], slots[order]

    def _found(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of parts in the memory, -1 for those that are not in it; a
        hash only points to a part, the code points decide."""
        if not len(self._hash):
            return np.full(len(begin), -1)
        hashes, back = np.unique(_hashes(codes, begin, size), return_inverse=True)
        at = np.minimum(np.searchsorted(self._hash, hashes), len(self._hash) - 1)
        slot = np.where(self._hash[at] == hashes, self._slot[at], -1)[back]
        same = (slot >= 0) & (np.diff(self._codes_at)[slot] == size)
        k = np.flatnonzero(same)
        differ = codes[_ranges(begin[k], size[k])] != self._codes[_ranges(self._codes_at[slot[k]], size[k])]
        same[np.repeat(k, size[k])[differ]] = False
        return np.where(same, slot, -1)

    def encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, the texts' offsets into them, and each id's first and last byte
        in its text, for texts as UTF-8 bytes with offsets."""
        codes, upto, align = self._normal(data, offs)
        kinds = self._class[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self._meet[kinds[:-1], kinds[1:]]
        cut[upto[:-1][np.diff(upto) > 0]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(codes)))
        slot = self._found(codes, begin, size)
        while (new := np.flatnonzero(slot < 0)).size:
            if 4 * len(self._codes) + 8 * len(self._ids) + 40 * len(self._hash) > REMEMBER:
                self.forget()
                new = np.arange(len(begin))
            _, first = np.unique(_hashes(codes, begin[new], size[new]), return_index=True)
            lens = size[new[first]]
            self._learn(codes[_ranges(begin[new[first]], lens)], np.concatenate([[0], np.cumsum(lens)]))
            slot[new] = self._found(codes, begin[new], size[new])
            if (slot[new] < 0).any():  # two parts of one hash, of which the memory has the other
                return self._apart(codes, upto, align)
        count = np.diff(self._ids_at)[slot]
        take = _ranges(self._ids_at[slot], count)
        ids, sizes = self._ids[take], self._size[take].astype(np.int64)
        ids_upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, upto)]
        return self._spans(ids, sizes, ids_upto, align)

    def _apart(self, codes: np.ndarray, upto: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``encoded`` without the memory."""
        ids, sizes = [], []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            x, y = self._spelt(codes[a:b], np.array(self._merge_long(codes[a:b]), np.int64))
            ids.append(x)
            sizes.append(y)
        flat = lambda x, kind: np.array(list(chain.from_iterable(x)), kind)
        return self._spans(flat(ids, np.int32), flat(sizes, np.int64), np.cumsum([0, *map(len, ids)]), align)

    def _spans(self, ids: np.ndarray, sizes: np.ndarray, upto: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.fallback and len(ids):  # unknown pieces in a row are one
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[upto[:-1][np.diff(upto) > 0]] = False
            own = np.flatnonzero(~again)
            sizes, ids, upto = np.add.reduceat(sizes, own), ids[own], np.searchsorted(own, upto)
        ends = np.cumsum(sizes)
        # after each text, the alignment has one offset more
        shift = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
        return ids, upto, align[ends - sizes + shift], align[ends + shift]

    # decoding

    def decoded(self, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """UTF-8 texts of rows of ids, ``upto`` being their offsets."""
        begin, size = self._upto[ids], self._upto[ids + 1] - self._upto[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self._said[np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))].tobytes()
        kinds, out = self.kinds[ids], []
        inner = np.concatenate([[0], np.cumsum(kinds == BYTE)])
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            text = data[ends[a] : ends[b]]
            first = a
            while first < b and kinds[first] == CONTROL:
                first += 1
            if inner[a] != inner[b]:
                text = self._with_bytes(ids[a:b].tolist())
            if (self.prefix or self.squeeze) and first < b and kinds[first] == NORMAL and text[:1] == b" ":
                text = text.lstrip(b" ") if self.squeeze else text[1:]
            out.append(text)
        return out

    def _with_bytes(self, ids: list[int]) -> bytes:
        """Bytes in a row are read as UTF-8; each that fits nowhere is U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode().encode())
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    size = 1
                    out.append("�".encode())
                at += size
            run.clear()

        for k in ids:
            if self.kinds[k] == BYTE:
                run += self._said[self._upto[k] : self._upto[k + 1]].tobytes()
            else:
                flush()
                out.append(self._said[self._upto[k] : self._upto[k + 1]].tobytes())
        flush()
        return b"".join(out)

    # single texts

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """id, first byte and end of every piece."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids, _, begin, end = self.encoded(data, np.array([0, len(data)]))
        return list(zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True))

    def encode(self, text: str | None, ends: bool = True) -> list[int]:
        ids = [k for k, _, _ in self.encode_spans(text)]
        return [self.begin, *ids, self.end] if ends else ids

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()


_MODELS: dict[str, Model] = {}


def model(data: bytes) -> Model:
    """One model for each worker process and file."""
    key = hashlib.md5(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def _file(df: DataFrame, path: str | None):
    """The model file (under 1 MB, whatever the input) for all executors."""
    with open(path or model_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _framed(values: np.ndarray, upto: np.ndarray, first: int, last: int | np.ndarray) -> np.ndarray:
    """Rows of values with one more before and one after each."""
    rows = np.arange(len(upto) - 1)
    out = np.empty(len(values) + 2 * len(rows), values.dtype)
    out[np.arange(len(values)) + 2 * np.repeat(rows, np.diff(upto)) + 1] = values
    out[upto[:-1] + 2 * rows], out[upto[1:] + 2 * rows + 1] = first, last
    return out


def _encoded(m: Model, col: pa.Array, ends: bool) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Runs of rows of about a megabyte: first row, row after the last, ids,
    begins and ends as one array each, and the rows' offsets into these.  Begin
    and end ids are empty spans at the text's ends."""
    for start, end, data, offs in pieces(col):
        ids, upto, first, last = m.encoded(data, offs)
        if ends:
            size = np.diff(offs)
            ids, first, last = _framed(ids, upto, m.begin, m.end), _framed(first, upto, 0, size), _framed(last, upto, 0, size)
            upto = upto + 2 * np.arange(len(upto))
        yield start, end, [ids, first, last], upto


def encode(df: DataFrame, path: str | None = None, text: str = "text", ends: bool = True) -> DataFrame:
    """``df`` without ``text``, with ``ids`` (with begin and end ids if
    ``ends``), and ``begins`` and ``ends``: each id's span in the text's UTF-8."""
    file, keep = _file(df, path), [f for f in df.schema.fields if f.name not in (text, "ids", "begins", "ends")]
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*keep, *(T.StructField(n, ints, False) for n in ("ids", "begins", "ends"))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file.value)
        for b in batches:
            for start, end, flat, upto in _encoded(m, column(b, text), ends):
                lists = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(x.astype(np.int32))) for x in flat]
                yield pa.RecordBatch.from_arrays([*(column(b, f.name).slice(start, end - start) for f in keep), *lists], names=[*(f.name for f in keep), "ids", "begins", "ends"])
        m.forget()

    return map_arrow(df, run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` without ``ids``, with the decoded ``text``; null ids are none."""
    file, keep = _file(df, path), [f for f in df.schema.fields if f.name not in (ids, "text")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType(), False)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file.value)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                rows = [x or [] for x in column(b, ids).slice(start, ROWS).to_pylist()]
                said = m.decoded(np.array(list(chain.from_iterable(rows)), np.int64), np.cumsum([0, *map(len, rows)]))
                yield pa.RecordBatch.from_arrays([*(column(b, f.name).slice(start, ROWS) for f in keep), pa.array([x.decode() for x in said], pa.string())], names=[*(f.name for f in keep), "text"])

    return map_arrow(df, run, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids, of the text decoded from them,
    and of the spans (begins, then ends, as 32-bit integers), in one pass."""
    file = _file(df, path)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for start, end, (ids, *spans), upto in _encoded(m, column(b, "text"), True):
                said = m.decoded(ids.astype(np.int64), upto)
                rows = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
                packed, first, last = (x.astype("<u4") for x in (ids, *spans))
                where = [sha(first[x:y].tobytes() + last[x:y].tobytes()) for x, y in rows]
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id").slice(start, end - start), pa.array(np.diff(upto), pa.int64()), pa.array([sha(packed[x:y].tobytes()) for x, y in rows]), pa.array(list(map(sha, said))), pa.array(where)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )
        m.forget()

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir))
