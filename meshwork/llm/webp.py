"""Media columns: lossless WebP in numpy.

``decode`` reads a lossless WebP file: prefix codes (simple and normal, several
groups by tile), back-references, colour cache, and the inverse of the
predictor, cross-colour, subtract-green and palette transforms; it gives an
array of height x width x RGBA.  ``encode`` writes such files, for the tests
with every one of these features; ``encode_bytes`` writes texts as grey images
and chooses by content: palette or subtract-green, after which a pixel is one
prefix code; predictor modes by tiles; back-references to the nearest place with
the same bytes; a colour cache; groups of prefix codes for bands of rows.
Predictor, cache and groups are taken where entropies say that they shorten the
file.  Cross-colour is never: in a grey image it can at best do what
subtract-green does, and needs an image of its own for it.

A stream with one prefix code a pixel is decoded for all bit positions at once
(how many bits), after which a short loop only follows the lengths; other
streams, those with a colour cache among them, are decoded pixel by pixel.

A text is stored as rows of 64 bytes, and more than 16,384 rows as several
files, end to end; a file of at most 16 different bytes has a palette.  The
query stores the files as a table and reads that.  A null text is empty and stored as one row of zeros.  Rows
are independent; equal texts give equal files.  Texts of a batch are worked at
together, 64 KB at a time, since short ones cost mostly by the numpy calls.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import column, lean, load, written

ROW = 64
MOST_SIDE = 1 << 14
#: Fixed values of the format: the order in which code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
#: The first 120 distance codes name near pixels (to the left, upwards), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# prefix codes


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code, flattened until none exceeds ``most``."""
    symbols = sorted(counts)
    weights = [counts[s] for s in symbols]
    n = len(symbols)
    if n == 1:
        return {symbols[0]: 1}
    while True:
        # leaves by weight, and sums, which come out in order: the two least are at their heads
        leaves = sorted(range(n), key=weights.__getitem__)
        least = [weights[k] for k in leaves]
        least.append(sum(least) + 1)
        above, sums = [0] * (2 * n - 1), []
        leaf = made = 0
        for node in range(n, 2 * n - 1):
            if made < len(sums) and sums[made] < least[leaf]:
                c, k, made = sums[made], n + made, made + 1
            else:
                c, k, leaf = least[leaf], leaves[leaf], leaf + 1
            above[k] = node
            if made < len(sums) and sums[made] < least[leaf]:
                c, k, made = c + sums[made], n + made, made + 1
            else:
                c, k, leaf = c + least[leaf], leaves[leaf], leaf + 1
            above[k] = node
            sums.append(c)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= most:
            return dict(zip(symbols, depth, strict=False))
        weights = [c // 2 + 1 for c in weights]


#: Numbers of 15 bits, backwards.
_TURNED = ((np.arange(1 << 15)[:, None] >> np.arange(15) & 1) @ (1 << np.arange(14, -1, -1))).tolist()


@functools.cache
def _turned(bits: int) -> np.ndarray:
    return np.array(_TURNED[: 1 << bits], np.int64) >> (15 - bits)


def _canonical(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, code with its first bit lowest, length), in canonical order."""
    out, code, before = [], 0, 0
    for both in sorted([n << 12 | s for s, n in lengths.items()]):
        n, s = both >> 12, both & 4095
        code <<= n - before
        out.append((s, _TURNED[code] >> (15 - n), n))
        code, before = code + 1, n
    return out


class Code:
    """Decoding table of a prefix code.  ``symbols`` and ``lengths`` are in
    canonical order, ``index`` tells the place there by the next ``bits`` bits
    (none if there is only one symbol)."""

    def __init__(self, lengths: dict[int, int]):
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        self.bits = 0 if self.only is not None else max(lengths.values())
        self.mask = (1 << self.bits) - 1
        if self.only is not None:
            self.symbols, self.lengths, self.index = np.array([self.only]), np.zeros(1, np.int64), np.zeros(1, np.intp)
            return
        order = np.array(sorted([n << 12 | s for s, n in lengths.items()]))
        self.symbols, self.lengths = order & 4095, order >> 12
        share = 1 << (self.bits - self.lengths)
        if share.sum() != 1 << self.bits:
            raise ValueError("the prefix code is not complete")
        # by canonical order the table is in the order of the bits, highest first
        self.index = np.repeat(np.arange(len(order)), share).take(_turned(self.bits))

    @functools.cached_property
    def table(self) -> list[tuple[int, int]]:
        """Symbol and length by the next bits."""
        pairs = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        return [pairs[k] for k in self.index.tolist()]


@functools.cache
def _single(symbol: int) -> Code:
    return Code({symbol: 1})


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), at

    def read(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        k = self.at >> 3
        window = int.from_bytes(self.data[k : k + 4], "little") >> (self.at & 7) & code.mask
        symbol, n = code.table[window]
        self.at += n
        return symbol


class Writer:
    """Collects (value, bits) and packs them, lowest bit first."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[int] = []
        self.few_sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.few.append(value)
        self.few_sizes.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def _flush(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.int64))
            self.sizes.append(np.array(self.few_sizes, np.int64))
            self.few, self.few_sizes = [], []

    def bytes(self) -> bytes:
        self._flush()
        return _packed(np.concatenate(self.values), np.concatenate(self.sizes), np.array([sum(map(len, self.values))]))[0]


def _packed(value: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of so many values each, as bytes of their bits, lowest first."""
    end = np.cumsum(size)
    stop = np.concatenate([[0], end])[np.cumsum(counts)]
    bits = np.diff(stop, prepend=0)
    words = (bits + 31) // 32 + 1
    base = np.cumsum(words) - words
    at = end - size + np.repeat(32 * base - stop + bits, counts)
    # values are disjoint bits: sums below 2**53 are exact
    wide = np.bincount(at >> 5, (value << (at & 31)).astype(np.float64), minlength=int(words.sum())).astype(np.int64)
    low = wide & 0xFFFFFFFF
    low[1:] += wide[:-1] >> 32
    data = low.astype("<u4").tobytes()
    return [data[4 * k : 4 * k + (n + 7) // 8] for k, n in zip(base.tolist(), bits.tolist(), strict=True)]


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 1
    extra = n - 1
    return 2 * n + ((value - 1) >> extra & 1), (value - 1) & ((1 << extra) - 1), extra


def _unprefix(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _length_table(lengths: dict[int, int]) -> tuple[list[tuple[int, int]], int]:
    """Symbol and length by the next bits, and their mask, of a small code."""
    if len(lengths) == 1:
        return [(next(iter(lengths)), 0)], 0
    size = 1 << max(lengths.values())
    table: list[tuple[int, int]] = [(0, 0)] * size
    if sum(size >> n for n in lengths.values()) != size:
        raise ValueError("the prefix code is not complete")
    for s, code, n in _canonical(lengths):
        table[code :: 1 << n] = [(s, n)] * (size >> n)
    return table, size - 1


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # simple
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return Code({first: 1, bits.read(8): 1}) if two else _single(first)
    count = 4 + bits.read(4)
    sizes = bits.read(3 * count)
    table, mask = _length_table({LENGTH_ORDER[k]: n for k in range(count) if (n := sizes >> 3 * k & 7)})
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: dict[int, int] = {}
    s, before = 0, 8
    # a token takes 14 bits at most
    k = bits.at >> 3
    window, p = int.from_bytes(bits.data[k : k + min(tokens, alphabet) * 14 // 8 + 9], "little"), bits.at & 7
    while s < alphabet and tokens:
        tokens -= 1
        t, n = table[window >> p & mask]
        p += n
        if t < 16:
            if t:
                lengths[s] = before = t
            s += 1
        elif t == 16:
            n = 3 + (window >> p & 3)
            p += 2
            lengths.update((k, before) for k in range(s, s + n))
            s += n
        elif t == 17:
            s += 3 + (window >> p & 7)
            p += 3
        else:
            s += 11 + (window >> p & 127)
            p += 7
    bits.at += p - (bits.at & 7)
    if s > alphabet:
        raise ValueError("more code lengths than symbols")
    return Code(lengths)


def _put_single(out: Writer, symbol: int) -> None:
    """A prefix code of one symbol."""
    out.few += [1, 0, int(symbol > 1), symbol]
    out.few_sizes += [1, 1, 1, 8 if symbol > 1 else 1]


def _write_code(out: Writer, lengths: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Writes a prefix code; returns code and length by symbol."""
    used = sorted(lengths)
    if len(used) == 1 and used[0] < 256:
        _put_single(out, used[0])
        return {used[0]: (0, 0)}
    if len(used) == 2 and used[1] < 256:
        wide = used[0] > 1
        out.few += [1, 1, int(wide), *used]
        out.few_sizes += [1, 1, 1, 8 if wide else 1, 8]
        return {used[0]: (0, 1), used[1]: (1, 1)}
    kinds: list[int] = []
    extras: list[int] = []
    at = 0
    for s in used:
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            kinds.append(18)
            extras.append(n - 11)
            gap -= n
        if gap >= 3:
            kinds.append(17)
            extras.append(gap - 3)
            gap = 0
        kinds += [0] * gap
        kinds.append(lengths[s])
        extras += [0] * (gap + 1)
        at = s + 1
    own = code_lengths(Counter(kinds), 7)
    count = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if s in own) + 1)
    out.put(0, 1)
    out.put(count - 4, 4)
    out.few += [own.get(s, 0) for s in LENGTH_ORDER[:count]]
    out.few_sizes += [3] * count
    by = {s: (c, n) for s, c, n in _canonical(own)} if len(own) > 1 else dict.fromkeys(own, (0, 0))
    if at < alphabet:
        out.put(1, 1)
        n = max(2, (len(kinds) - 2).bit_length())
        n += n & 1
        out.put((n - 2) // 2, 3)
        out.put(len(kinds) - 2, n)
    else:
        out.put(0, 1)
    # a token's extra bits follow its code
    out.few += [by[t][0] | extra << by[t][1] for t, extra in zip(kinds, extras, strict=True)]
    more = {t: n + (3 if t == 17 else 7 if t == 18 else 0) for t, (_, n) in by.items()}
    out.few_sizes += [more[t] for t in kinds]
    return {s: (c, n) for s, c, n in _canonical(lengths)} if len(lengths) > 1 else dict.fromkeys(lengths, (0, 0))


# pixels, as 0xAARRGGBB


@functools.cache
def _near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR])


@functools.cache
def _near(width: int) -> np.ndarray:
    """The least code of each distance that names a near pixel; 0: none, as for
    all distances from the last one."""
    codes = np.zeros(8 * width + 16, np.int64)
    for k, d in reversed(list(enumerate(_near_distances(width).tolist(), 1))):
        codes[d] = k
    return codes


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Extra bits and least value of the 40 symbols of lengths and distances.
_EXTRA = np.array([0, 0, 0, 0, *((k - 2) >> 1 for k in range(4, 40))], np.int64)
_LEAST = np.array([1, 2, 3, 4, *(((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(4, 40))], np.int64)


#: What a green symbol adds to its code's bits: of a length the extra bits, and a mark.
COPY = 128
_MORE = np.concatenate([np.zeros(256, np.int64), _EXTRA[:24] + COPY])


def _sizes(window: np.ndarray, green: Code, distance: Code) -> tuple[np.ndarray, np.ndarray]:
    """The bits of a token at every bit position, and which would be copies."""
    step = (green.lengths + _MORE[green.symbols]).astype(np.uint8).take(green.index)
    size = step.take((window & np.uint32(green.mask)).astype(np.intp))
    at = np.flatnonzero(size >= COPY)
    if len(at):
        own = size[at] & np.uint8(COPY - 1)
        step = (distance.lengths + _EXTRA[distance.symbols]).astype(np.uint8).take(distance.index)
        size[at] = own + step.take(window.take(at + own, mode="clip") & np.uint32(distance.mask))
    return size, at


def _copied(window: np.ndarray, at: np.ndarray, green: Code, distance: Code, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and distances of the copies at bit positions."""
    place = green.index.take(window[at] & np.uint32(green.mask))
    kind = green.symbols[place] - 256
    at, extra = at + green.lengths[place], _EXTRA[kind]
    length = _LEAST[kind] + (window.take(at, mode="clip") & ((1 << extra) - 1))
    at = at + extra
    place = distance.index.take(window.take(at, mode="clip") & np.uint32(distance.mask))
    kind = distance.symbols[place]
    far = _LEAST[kind] + (window.take(at + distance.lengths[place], mode="clip") & ((1 << _EXTRA[kind]) - 1))
    return length, np.where(far > len(NEAR), far - len(NEAR), _near_distances(width).take(far - 1, mode="clip"))


_SHIFTS = np.tile(np.arange(8, dtype=np.uint32), 1 << 14)


def _plane(bits: Bits, codes: list[list[Code]], bands: list[int], band: int, width: int, total: int) -> np.ndarray:
    """The green of pixels that take one prefix code each, with the bits of
    tokens found for all positions at once; ``bands``: the group of every
    ``band`` pixels."""
    base = bits.at >> 3
    # no more bits than every pixel could take; eight bytes follow the file's
    n = min(((bits.at & 7) + total * 64 + 7) // 8 + 8, len(bits.data) - 3 - base)
    if n <= 0:
        raise ValueError("the file ends early")
    window = np.repeat(np.ndarray((n,), "<u4", bits.data, base, (1,)).copy(), 8)
    window >>= _SHIFTS[: 8 * n] if 8 * n <= len(_SHIFTS) else np.tile(_SHIFTS[:8], n)
    p, stop = bits.at & 7, len(window)
    sized = {g: _sizes(window, codes[g][0], codes[g][4]) for g in set(bands)}
    raws = {g: size.tobytes() for g, (size, _) in sized.items()}
    if len(sized) == 1:
        # four tokens at a step, filled in afterwards
        one = np.arange(stop + 1, dtype=np.intp if stop < 1 << 20 else np.int32)
        one[:-1] += sized[bands[0]][0]
        tail = one[-64:]  # a token takes 58 bits at most
        np.minimum(tail, stop, out=tail)
        two = one.take(one, mode="clip")
        four = memoryview(two.take(two, mode="clip"))
        steps: list[int] = []
        add = steps.append
        while p < stop:
            add(p)
            p = four[p]
        starts = np.array(steps, np.intp)
        for jump in (two, one):
            both = np.empty((len(starts), 2), np.intp)
            both[:, 0], both[:, 1] = starts, jump.take(starts, mode="clip")
            starts = both.reshape(-1)
        parts = [(bands[0], starts[: np.searchsorted(starts, stop)])]
    else:
        runs = {}
        for g, (_, at) in sized.items():
            run = np.ones(stop, np.int32)
            run[at] = _copied(window, at, codes[g][0], codes[g][4], width)[0]
            runs[g] = memoryview(run)
        parts, done = [], 0
        for k, g in enumerate(bands):
            raw, run, starts, end = raws[g], runs[g], [], min(total, (k + 1) * band)
            while done < end:
                if p >= stop:
                    raise ValueError("the file ends early")
                starts.append(p)
                done += run[p]
                p += raw[p]
            parts.append((g, np.array(starts, np.int64)))
    symbols, lengths, copies, backs, before = [], [], [], [], 0
    for g, starts in parts:
        green = codes[g][0]
        symbol = green.symbols.take(green.index.take(window.take(starts) & np.uint32(green.mask)))
        n, which = np.ones(len(starts), np.int64), np.flatnonzero(symbol >= 256)
        if len(which):
            n[which], back = _copied(window, starts[which], green, codes[g][4], width)
            copies.append(which + before)
            backs.append(back)
        symbols.append(symbol)
        lengths.append(n)
        before += len(starts)
    symbol, n, starts = (symbol, n, starts) if len(parts) == 1 else (np.concatenate(x) for x in (symbols, lengths, [x for _, x in parts]))
    end = np.cumsum(n)
    if not len(end) or end[-1] < total:
        raise ValueError("the file ends early")
    used = int(np.searchsorted(end, total)) + 1
    final = int(starts[used - 1])
    bits.at = 8 * base + final + raws[parts[-1][0]][final]
    begin = end[:used] - n[:used]
    out = bytearray(total)
    np.frombuffer(out, np.uint8)[begin] = symbol[:used].astype(np.uint8)  # copies overwrite theirs
    if not copies:
        return np.frombuffer(out, np.uint8)
    which = np.concatenate(copies)
    which = which[: np.searchsorted(which, used)]
    for at, k, back in zip(begin[which].tolist(), n[which].tolist(), np.concatenate(backs)[: len(which)].tolist(), strict=True):
        k = min(k, total - at)
        if back > at:
            raise ValueError("a back-reference reaches before the image")
        if back >= k:
            out[at : at + k] = out[at - back : at - back + k]
        else:  # it reads what it has written
            out[at : at + k] = (out[at - back : at] * (k // back + 1))[:k]
    return np.frombuffer(out, np.uint8)


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """One entropy-coded image; ``top``: the one that may have several groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tiles, tile_bits, groups = None, 0, 1
    if top and bits.read(1):
        tile_bits = bits.read(3) + 2
        across = -(-width // (1 << tile_bits))
        tiles = (_pixels(bits, across, -(-height // (1 << tile_bits)), False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(-1, across)
        groups = int(tiles.max()) + 1
    sizes = [ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:]]
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    first = codes[0]
    fixed = {tuple(c.only for c in g[1:4]) for g in codes}
    if not cache_bits and len(fixed) == 1 and None not in (only := next(iter(fixed))) and all(g[0].only is None for g in codes) and (tiles is None or tiles.shape[1] == 1):
        bands = [0] if tiles is None else tiles[:, 0].tolist()
        plane = _plane(bits, codes, bands, total if tiles is None else width << tile_bits, width, total)
        return plane.astype(np.uint32) << np.uint32(8) | np.uint32(only[2] << 24 | only[0] << 16 | only[1])
    out: list[int] = []
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, distance = codes[int(tiles[at // width >> tile_bits, at % width >> tile_bits])] if tiles is not None else first
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            out.append(bits.symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _unprefix(s - 256, bits)
            back = _distance(_unprefix(bits.symbol(distance), bits), width)
            if back > at:
                raise ValueError("a back-reference reaches before the image")
            for _ in range(min(n, total - at)):
                out.append(out[-back])
        else:
            while cached < at:  # all pixels before this one are in the cache by now
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as the last axis, in int32."""
    return np.stack([argb >> np.uint32(k) & np.uint32(255) for k in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left, top, corner, beyond) -> list[int]:
    """A pixel's channels from its neighbours', by one of the 14 modes."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return beyond
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, beyond), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, beyond)
    if mode == 10:
        return mean(mean(left, corner), mean(top, beyond))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predictor(pixels: np.ndarray, modes: np.ndarray, tile_bits: int, inverse: bool) -> np.ndarray:
    """Adds (or takes) the predictions of all pixels in order."""
    h, w = pixels.shape
    given = _channels(pixels).tolist()
    made = [[[0] * 4 for _ in range(w)] for _ in range(h)]
    known = made if inverse else given
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = known[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = known[y - 1][0]
            else:
                beyond = known[y - 1][x + 1] if x + 1 < w else known[y][0]
                guess = _predicted(int(modes[y >> tile_bits, x >> tile_bits]), known[y][x - 1], known[y - 1][x], known[y - 1][x - 1], beyond)
            made[y][x] = [(a + b if inverse else a - b) & 255 for a, b in zip(given[y][x], guess, strict=True)]
    return _joined(np.array(made, np.int32).reshape(h, w, 4))


def _guess(mode: int, left, top, corner, beyond):
    """One channel's prediction, of numbers or arrays, by one of the 14 modes."""
    if mode in (1, 2, 3, 4):
        return (left, top, beyond, corner)[mode - 1]
    if mode == 5:
        return (((left + beyond) >> 1) + top) >> 1
    if mode in (6, 7, 8, 9):
        x, y = ((left, corner), (left, top), (corner, top), (top, beyond))[mode - 6]
        return (x + y) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + beyond) >> 1)) >> 1
    if mode == 11:
        return np.where(abs(top - corner) < abs(left - corner), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = (left + top) >> 1
        d = m - corner
        return np.clip(m + ((d + (d < 0)) >> 1), 0, 255)  # halves are cut towards zero
    return 0 * top


def _unpredicted(rest: np.ndarray, modes: np.ndarray, tile_bits: int) -> np.ndarray:
    """A plane from what its predictions left.  Rows whose modes look upwards
    only are made at once, rows predicted from the left by sums."""
    h, w = rest.shape
    out = np.zeros((h, w), np.int64)
    out[0] = np.cumsum(rest[0]) & 255
    for y in range(1, h):
        m = np.repeat(modes[y >> tile_bits], 1 << tile_bits)[1:w]
        up, row = out[y - 1], rest[y].astype(np.int64)
        row[0] = (row[0] + up[0]) & 255
        kinds = set(m.tolist())
        if kinds <= {1}:
            out[y] = np.cumsum(row) & 255
        elif kinds <= {0, 2, 3, 4, 8, 9}:
            out[y, 0] = row[0]
            beyond = np.append(up[2:], row[0])
            for k in kinds:
                some = m == k
                out[y, 1:][some] = ((row[1:] + _guess(k, None, up[1:], up[:-1], beyond)) & 255)[some]
        else:
            top, left, r = [*up.tolist(), int(row[0])], int(row[0]), row.tolist()
            made = [left]
            for x, k in enumerate(m.tolist(), 1):
                left = (r[x] + int(_guess(k, left, top[x], top[x - 1], top[x + 1]))) & 255
                made.append(left)
            out[y] = made
    return out.astype(np.uint8)


def _cross(pixels: np.ndarray, tiles: np.ndarray, tile_bits: int, inverse: bool) -> np.ndarray:
    """Cross-colour: red and blue by shares of green, blue also by one of red."""
    h, w = pixels.shape
    c = _channels(pixels)
    t = _channels(np.repeat(np.repeat(tiles, 1 << tile_bits, 0), 1 << tile_bits, 1)[:h, :w])
    signed = lambda x: ((x & 255) ^ 128) - 128
    delta = lambda a, b: signed(a) * signed(b) >> 5
    sign = 1 if inverse else -1
    red = c[..., 1] + sign * delta(t[..., 3], c[..., 2])
    true_red = red if inverse else c[..., 1]
    c[..., 3] += sign * (delta(t[..., 2], c[..., 2]) + delta(t[..., 1], true_red))
    c[..., 1] = red
    return _joined(c)


def _subtract(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    both = green << np.uint32(16) | green
    rest = pixels & np.uint32(0xFF00FF)
    rest = (rest + both if inverse else rest + np.uint32(0x1000100) - both) & np.uint32(0xFF00FF)
    return pixels & np.uint32(0xFF00FF00) | rest


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unbundle(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    per = _bundle(len(table))
    size = 8 >> per
    index = (pixels >> np.uint32(8) & np.uint32(255))[:, :, None] >> (np.arange(1 << per, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index.reshape(len(pixels), -1)[:, :width]]


def image(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file, as 0xAARRGGBB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            tile_bits = bits.read(3) + 2
            across = -(-wide // (1 << tile_bits))
            tiles = _pixels(bits, across, -(-height // (1 << tile_bits)), False).reshape(-1, across)
            undo.append((kind, tile_bits, tiles, wide))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(_pixels(bits, colours, 1, False)), axis=0))
            undo.append((kind, 0, table, wide))
            wide = -(-wide // (1 << _bundle(colours)))
        else:
            undo.append((kind, 0, None, wide))
    pixels = _pixels(bits, wide, height, True).reshape(height, wide)
    if bits.at > 8 * (len(bits.data) - 8):
        raise ValueError("the file ends early")
    for kind, tile_bits, extra, wide in reversed(undo):
        if kind == SUBTRACT:
            pixels = _subtract(pixels, True)
        elif kind == PALETTE:
            pixels = _unbundle(pixels, extra, wide)
        elif kind == CROSS:
            pixels = _cross(pixels, extra, tile_bits, True)
        elif not (pixels & np.uint32(0xFFFF00FF)).any():  # green alone differs from black
            modes = extra >> np.uint32(8) & np.uint32(15)
            pixels = _unpredicted(pixels >> np.uint32(8), modes, tile_bits).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
        else:
            pixels = _predictor(pixels, extra >> np.uint32(8) & np.uint32(15), tile_bits, True)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """Height x width x RGBA of one lossless WebP file."""
    pixels = image(data)
    return np.stack([pixels >> np.uint32(k) & np.uint32(255) for k in (16, 8, 0, 24)], axis=-1).astype(np.uint8)


# writing

#: A token: green symbol (literal, length or cache), and a literal's other
#: channels, or a copy's length and distance.
def _tokens(pixels: np.ndarray, cache_bits: int, copies: bool) -> list[tuple]:
    flat, out, last, cache = pixels.reshape(-1).tolist(), [], {}, {}
    at, shift = 0, 32 - cache_bits
    while at < len(flat):
        n = back = 0
        if copies and at + 3 <= len(flat):
            if (found := last.get(tuple(flat[at : at + 3]))) is not None:
                back = at - found
                while n < 4096 and at + n < len(flat) and flat[at + n] == flat[at + n - back]:
                    n += 1
        if n >= 3:
            out.append((at, "copy", n, back))
        elif cache_bits and cache.get(key := (CACHE_MULTIPLIER * flat[at] & 0xFFFFFFFF) >> shift) == flat[at]:
            n = 1
            out.append((at, "cache", key, 0))
        else:
            n = 1
            out.append((at, "pixel", flat[at], 0))
        for k in range(at, at + n):
            if copies and k + 3 <= len(flat):
                last[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_MULTIPLIER * flat[k] & 0xFFFFFFFF) >> shift] = flat[k]
        at += n
    return out


def _write_pixels(out: Writer, pixels: np.ndarray, cache_bits: int = 0, copies: bool = False, tile_bits: int = 0, top: bool = False) -> None:
    """Any image, pixel by pixel; with ``tile_bits``, two groups by turns."""
    h, w = pixels.shape
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(int(tile_bits > 0), 1)
    group = np.zeros((1, 1), np.uint32)
    if tile_bits:
        out.put(tile_bits - 2, 3)
        rows, cols = -(-h // (1 << tile_bits)), -(-w // (1 << tile_bits))
        group = (np.arange(rows)[:, None] + np.arange(cols)[None, :]).astype(np.uint32) % np.uint32(2)
        _write_pixels(out, group << np.uint32(8))
    of = lambda at: int(group[at // w >> tile_bits, at % w >> tile_bits]) if tile_bits else 0
    tokens = _tokens(pixels, cache_bits, copies)
    counts = [[Counter() for _ in range(5)] for _ in range(int(group.max()) + 1)]
    for at, kind, a, b in tokens:
        c = counts[of(at)]
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][a >> s & 255] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + _prefix(a)[0]] += 1
            c[4][_prefix(b + len(NEAR))[0]] += 1
    sizes = [ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:]]
    codes = [[_write_code(out, code_lengths(n or {0: 1}), size) for n, size in zip(c, sizes, strict=True)] for c in counts]
    for at, kind, a, b in tokens:
        code = codes[of(at)]
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                out.put(*code[k][a >> s & 255])
        elif kind == "cache":
            out.put(*code[0][280 + a])
        else:
            for k, first, value in ((0, 256, a), (4, 0, b + len(NEAR))):
                s, extra, n = _prefix(value)
                out.put(*code[k][first + s])
                out.put(extra, n)


def _start(width: int, height: int, alpha: bool) -> Writer:
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    return out


def _file(bits: bytes) -> bytes:
    body = b"\x2f" + bits
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def encode(rgba: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = True, tile_bits: int = 0, modes: np.ndarray | None = None, crosses: np.ndarray | None = None) -> bytes:
    """A lossless WebP file of height x width x RGBA, with the transforms in the
    given order.  ``modes`` and ``crosses``: predictor modes, and cross-colour
    elements (0, red to blue, green to blue, green to red), by tiles of 4 x 4."""
    h, w, _ = rgba.shape
    pixels = _joined(rgba[..., [3, 0, 1, 2]].astype(np.int32))
    out = _start(w, h, True)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == SUBTRACT:
            pixels = _subtract(pixels, False)
        elif kind == PALETTE:
            table, index = np.unique(pixels, return_inverse=True)
            out.put(len(table) - 1, 8)
            _write_pixels(out, _joined(np.diff(_channels(table), axis=0, prepend=0))[None, :])
            per = _bundle(len(table))
            index = index.reshape(pixels.shape)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << per))))
            index = (index.reshape(h, -1, 1 << per) << (np.arange(1 << per) * (8 >> per))).sum(axis=2)
            pixels = (index.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
        else:
            out.put(0, 3)
            rows, cols = -(-h // 4), -(-pixels.shape[1] // 4)
            if kind == PREDICTOR:
                m = (modes if modes is not None else np.full((rows, cols), 11))[:rows, :cols].astype(np.uint32)
                _write_pixels(out, m << np.uint32(8) | np.uint32(0xFF000000))
                pixels = _predictor(pixels, m, 2, False)
            else:
                t = _joined((crosses if crosses is not None else np.full((rows, cols, 4), 5))[:rows, :cols])
                _write_pixels(out, t)
                pixels = _cross(pixels, t, 2, False)
    out.put(0, 1)
    _write_pixels(out, pixels, cache_bits, copies, tile_bits, top=True)
    return _file(out.bytes())


#: Bytes by which a passage is found, and the least that it must have.
KEY, LEAST_COPY = 8, 12
#: Longest prefix code of the writer; the format allows 15.
LONGEST = 12
#: Bits that a further group must save beyond its codes, and share of its bits that a cache must.
GROUP_GAIN, CACHE_GAIN = 400, 0.03
#: Tiles of a group span whole rows: bands of at least 64 rows.
BAND_BITS, MOST_BANDS = 6, 32
PREDICT_BITS = 3
_GREY = np.arange(256, dtype=np.int64) << 8 | 0xFF000000
#: Cache entries of grey pixels as the caches see them, by their bits and by alpha.
_KEYS = {(b, alpha): ((_GREY & 0xFFFF | alpha << 24) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - b) for b in (1, 2, 3, 4, 6, 8) for alpha in (0, 255)}
_COST = np.log2(1 + np.minimum(np.arange(256), 256 - np.arange(256))).astype(np.float32)
_LOG = np.concatenate([[0.0], np.log2(np.arange(1, 1 << 14)) * np.arange(1, 1 << 14)])


def _weighed(n: np.ndarray) -> np.ndarray:
    """n log2 n, alike whatever stands beside it."""
    out = _LOG.take(n, mode="clip")
    return out if n.max() < len(_LOG) else np.where(n < len(_LOG), out, n * np.log2(np.maximum(n, 1)))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of symbols by their counts, along the last axis."""
    return _weighed(counts.sum(axis=-1)) - _weighed(counts).sum(axis=-1)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra bits and their numbers of lengths or distances."""
    symbol = np.searchsorted(_LEAST, values, "right") - 1
    return symbol, values - _LEAST[symbol], _EXTRA[symbol]


def _copies(x: bytes, offs: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """Disjoint passages (start, length, distance) that repeat the nearest
    earlier place of their block with the same eight bytes.  ``offs``: where
    blocks begin and end; ``owner``: the block of every byte."""
    n = len(x) - KEY + 1
    key = np.ndarray((n,), "<u8", x, strides=(1,)).copy()
    # a hash of 43 bits, and the place: places of a block follow each other
    both = key * np.uint64(0x9E3779B97F4A7C15)
    both &= np.uint64((1 << 64) - (1 << 21))
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    same = np.flatnonzero((both[1:] ^ both[:-1]) < np.uint64(1 << 21))
    if not len(same):
        return []
    now, before = ((both.take(k) & np.uint64((1 << 21) - 1)).view(np.int64) for k in (same + 1, same))
    block = owner.take(now)
    good = (key.take(now) == key.take(before)) & (before >= offs.take(block)) & (now + KEY <= offs.take(block + 1))
    back = np.zeros(n, np.int32)
    back[now] = np.where(good, now - before, 0)
    edges = np.flatnonzero(back[1:] != back[:-1]) + 1
    edges = np.concatenate([[0], edges, [n]])
    first, end, back = edges[:-1], edges[1:] + KEY - 1, back[edges[:-1]]
    some = (back > 0) & (end - first >= LEAST_COPY)
    out, at = [], 0
    for s, e, d in zip(first[some].tolist(), end[some].tolist(), back[some].tolist(), strict=True):
        if s < at:
            s = at
        if e - s >= LEAST_COPY:
            if e - s <= 4096:
                out.append((s, e - s, d))
            else:
                out += [(k, min(4096, e - k), d) for k in range(s, e, 4096)]
            at = e
    return out


def _modes(plane: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The best predictor modes of tiles and what they leave; None if the bytes
    themselves, of these counts, are shorter, or shorter with a cache."""
    h, w = plane.shape
    flat = plane.reshape(-1)
    own = _entropy(counts)
    v = plane.astype(np.int64)
    left, top, corner = v[1:, :-1], v[:-1, 1:], v[:-1, :-1]
    beyond = np.concatenate([v[:-1, 2:], v[1:, :1]], axis=1)
    rest = np.stack([((v[1:, 1:] - _guess(k, left, top, corner, beyond)) & 255).astype(np.uint8) for k in range(14)])
    cost = np.zeros((14, -(-h >> PREDICT_BITS) << PREDICT_BITS, -(-w >> PREDICT_BITS) << PREDICT_BITS), np.float32)
    cost[:, 1:h, 1:w] = _COST[rest]
    side = 1 << PREDICT_BITS
    modes = cost.reshape(14, cost.shape[1] // side, side, cost.shape[2] // side, side).sum(axis=(2, 4)).argmin(axis=0)
    every = np.repeat(np.repeat(modes, side, 0), side, 1)[1:h, 1:w]
    out = np.diff(v, axis=0, prepend=0)
    out[0] = np.diff(v[0], prepend=0)
    out[1:, 1:] = np.take_along_axis(rest, every[None], 0)[0]
    out = (out & 255).astype(np.uint8)
    bits = _entropy(np.bincount(out.reshape(-1), minlength=256)) + _entropy(np.bincount(modes.reshape(-1))) + 64
    return (modes, out) if bits < own and bits < _cached(flat, np.arange(len(flat)), 255)[2] else None


def _cached(a: np.ndarray, literal: np.ndarray, alpha: int) -> tuple[int, np.ndarray, float]:
    """Bits of the best colour cache (0: none), the literals' symbols, and what
    they take, if a cache was tried."""
    plain = a.take(literal).astype(np.int64)
    bits, symbols = 0, plain
    # a cache gains by what came just before
    if 4 * (np.count_nonzero(a[1:] == a[:-1]) + np.count_nonzero(a[2:] == a[:-2])) < len(a):
        return bits, symbols, np.inf
    counts = np.bincount(symbols)
    own = best = _entropy(counts)
    kinds = np.count_nonzero(counts)
    for b in (1, 2, 3, 4, 6, 8):
        keys = _KEYS[b, alpha]
        order = np.argsort(keys.astype(np.uint8).take(a), kind="stable")  # keys are of 8 bits at most
        sorted_a = a.take(order)
        hit = np.zeros(len(a), bool)
        hit[order[1:]] = sorted_a[1:] == sorted_a[:-1]  # equal pixels have equal keys
        some = np.where(hit.take(literal), keys.take(plain) + 280, plain)
        cost = _entropy(counts := np.bincount(some)) + 4 * np.count_nonzero(counts) - 4 * kinds
        if cost < min(best, (1 - CACHE_GAIN) * own):
            best, bits, symbols = cost, b, some
    return bits, symbols, best


def _groups(counts: np.ndarray) -> np.ndarray:
    """The group of each band, by counts of its symbols: a band joins the group
    that it lengthens least, or has its own if that is shorter with its codes."""
    held: list[np.ndarray] = []
    out = []
    for own in counts:
        new = _entropy(own) + 5 * np.count_nonzero(own) + GROUP_GAIN
        more = [_entropy(g + own) - _entropy(g) + 5 * np.count_nonzero((g == 0) & (own > 0)) for g in held]
        if not more or new < min(more):
            held.append(own.copy())
            out.append(len(held) - 1)
        else:
            out.append(int(np.argmin(more)))
            held[out[-1]] += own
    return np.array(out)


def _counted(counts: np.ndarray) -> dict[int, int]:
    """The symbols that occur, and how often."""
    seen = np.flatnonzero(counts)
    return dict(zip(seen.tolist(), counts[seen].tolist(), strict=True))


def _put_codes(table: np.ndarray, rows: np.ndarray, codes: dict[int, tuple[int, int]]) -> None:
    table[rows[:, None], list(codes)] = [c << 4 | n for c, n in codes.values()]


def _worth_predicting(a: np.ndarray, offs: np.ndarray, owner: np.ndarray, width: int, counts: np.ndarray) -> np.ndarray:
    """Of blocks of rows of one width and their counts of bytes: may predictors
    shorten them, judged by left and top?"""
    n, own = len(counts), _entropy(counts)
    base, rows = owner * 256, a.reshape(-1, width)
    seam, above = offs[1:-1], offs[1:-1] // width  # places and rows without one before, but for the first
    left, top = a[1:] - a[:-1], rows[1:] - rows[:-1]
    lefts = np.bincount(base[1:] + left, minlength=256 * n)
    lefts[base[seam] + left[seam - 1]] -= 1
    tops = np.bincount(base[width:] + top.reshape(-1), minlength=256 * n)
    tops -= np.bincount((base[seam][:, None] + top[above - 1]).reshape(-1), minlength=256 * n)
    both = _entropy(np.stack([lefts, tops]).reshape(2, n, 256)).min(axis=0)
    return (np.diff(offs) > width) & (own >= 256) & (both <= 1.05 * own)


def _transformed(x: bytes, counts: np.ndarray, predict: bool) -> tuple[Writer, np.ndarray, int, int]:
    """The head of a file up to its transforms, what these leave of the bytes,
    pixels in a row, and alpha."""
    a = np.frombuffer(x, np.uint8)
    height, width = len(x) // ROW, ROW
    out = _start(ROW, height, False)
    out.put(1, 1)
    greys = np.flatnonzero(counts)
    if len(greys) <= 16:
        out.put(PALETTE, 2)
        out.put(len(greys) - 1, 8)
        colours = greys.astype(np.int32)[:, None] * np.array([0, 1, 1, 1], np.int32) + np.array([255, 0, 0, 0], np.int32)
        _write_pixels(out, _joined(np.diff(colours, axis=0, prepend=0))[None, :])
        per = _bundle(len(greys))
        index = np.searchsorted(greys, a).reshape(-1, 1 << per)
        a = (index << (np.arange(1 << per) * (8 >> per))).sum(axis=1).astype(np.uint8)
        width = ROW >> per
        counts, size = np.bincount(a, minlength=256), np.array([0, len(a)])
        predict = bool(_worth_predicting(a, size, np.zeros(len(a), np.int64), width, counts[None])[0])
    else:
        out.put(SUBTRACT, 2)
    alpha = 255
    if predict and (found := _modes(a.reshape(height, width), counts)) is not None:
        modes, rest = found
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(PREDICT_BITS - 2, 3)
        _write_pixels(out, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), copies=True)
        a, alpha = rest.reshape(-1), 0
    out.put(0, 1)  # no more transforms
    return out, a, width, alpha


def encode_bytes(x: bytes) -> bytes:
    """A grey image of the bytes, in rows of 64: one file."""
    return encode_blocks([x])[0]


def encode_blocks(blocks: list[bytes]) -> list[bytes]:
    """A grey image of each block, in rows of 64: one file each, which does not
    depend on the other blocks; they are only worked at together, 2 MB at most.

    By content: at most 16 different bytes become a palette, with two, four or
    eight pixels as one; others are stored by subtract-green, after which red
    and blue are constant, so that cross-colour has nothing left to take.  A
    predictor for each tile, a colour cache, and groups of prefix codes for
    bands of rows are taken where they make the file shorter by its entropy;
    passages of twelve bytes and more that stood before are back-references."""
    offs = np.cumsum([0, *map(len, blocks)])
    if offs[-1] > 1 << 21:
        raise ValueError("too many bytes for one call")
    owner = np.repeat(np.arange(len(blocks)), np.diff(offs))
    a = np.frombuffer(b"".join(blocks), np.uint8)
    own = np.bincount(owner * 256 + a, minlength=256 * len(blocks)).reshape(-1, 256)
    predict = _worth_predicting(a, offs, owner, ROW, own).tolist()
    outs, planes, widths, alphas = zip(*map(_transformed, blocks, own, predict), strict=True)
    heights = np.diff(offs) // ROW
    width = np.array(widths)
    a, offs = np.concatenate(planes), np.cumsum([0, *map(len, planes)])
    owner = np.repeat(np.arange(len(blocks)), np.diff(offs))
    copies = _copies(a.tobytes(), offs, owner)
    m = len(copies)
    start, n, back = np.array(copies, np.int64).reshape(m, 3).T
    # literals before, between and after the copies
    runs = np.zeros(2 * m + 1, np.int64)
    runs[:-1:2], runs[1::2] = start, n
    runs[2::2], runs[-1] = runs[2::2] - start - n, len(a) - (start[-1] + n[-1] if m else 0)
    gaps = runs[::2]
    where = np.flatnonzero(np.repeat(np.arange(2 * m + 1) & 1 == 0, runs))
    of, of_copy = owner.take(where), owner.take(start)
    # a cache gains by what came just before
    recent = np.zeros((2, len(a)), np.uint8)
    for k in (1, 2):
        recent[k - 1, k:] = a[k:] == a[:-k]
        recent[k - 1, (offs[:-1, None] + np.arange(k)).reshape(-1)] = 0
    often = np.add.reduceat(recent, offs[:-1], axis=1, dtype=np.int64).sum(axis=0)
    symbols, caches = a.take(where).astype(np.int64), [0] * len(blocks)
    for d in np.flatnonzero(4 * often >= np.diff(offs)).tolist():
        low, high = np.searchsorted(where, offs[d : d + 2]).tolist()
        caches[d], symbols[low:high], _ = _cached(planes[d], where[low:high] - offs[d], alphas[d])
    greens = [ALPHABETS[0] + (1 << c if c else 0) for c in caches]
    green = max(greens)
    far = back + len(NEAR)
    for w in set(widths):
        near = _near(w).take(back, mode="clip")
        far = np.where((near > 0) & (width.take(of_copy) == w), near, far)
    (n_symbol, n_extra, n_size), (far_symbol, far_extra, far_size) = _prefixes(n), _prefixes(far)
    # bands of rows, each with a group of codes
    band_bits = np.full(len(blocks), BAND_BITS)
    for _ in range(BAND_BITS, 9):
        band_bits += (heights >> band_bits > MOST_BANDS) & (band_bits < 9)
    bands = -(-heights >> band_bits)
    ends = np.cumsum(bands)
    begin, band, band_copy = ends - bands, of, of_copy
    if ends[-1] > len(blocks):
        shift = np.log2(width).astype(np.int64) + band_bits
        band, band_copy = (begin.take(d) + (at - offs.take(d) >> shift.take(d)) for at, d in ((where, of), (start, of_copy)))
    # where each token has its symbols among those of all bands
    symbols += band * green
    n_place, far_place = band_copy * green + 256 + n_symbol, band_copy * 40 + far_symbol
    counts = (np.bincount(symbols, minlength=int(ends[-1]) * green) + np.bincount(n_place, minlength=int(ends[-1]) * green)).reshape(-1, green)
    fars = np.bincount(far_place, minlength=int(ends[-1]) * 40).reshape(-1, 40)
    # of every symbol the code, and below it its length, by bands
    codes, far_codes = np.zeros((len(counts), green), np.int64), np.zeros((len(counts), 40), np.int64)
    for out, cache_bits, alpha, most, bits, low, high in zip(outs, caches, alphas, greens, band_bits.tolist(), begin.tolist(), ends.tolist(), strict=True):
        out.put(int(cache_bits > 0), 1)
        if cache_bits:
            out.put(cache_bits, 4)
        group = _groups(counts[low:high, :most]) if high > low + 1 else np.zeros(1, np.int64)
        groups = int(group.max()) + 1
        out.put(int(groups > 1), 1)
        if groups > 1:
            out.put(bits - 2, 3)
            _write_pixels(out, group.astype(np.uint32)[:, None] << np.uint32(8))
        for g in range(groups):
            mine = low + np.flatnonzero(group == g)
            by = _counted(counts[mine].sum(axis=0))
            if len(by) == 1:
                by[0 if 0 not in by else 1] = 1
            _put_codes(codes, mine, _write_code(out, code_lengths(by, LONGEST), most))
            for only in (0, 0, alpha):
                _put_single(out, only)
            _put_codes(far_codes, mine, _write_code(out, code_lengths(_counted(fars[mine].sum(axis=0)) or {0: 1}, LONGEST), ALPHABETS[4]))
    # the heads, then literals, which take one place in the stream, and copies, which take four
    heads = np.array([len(out.few) for out in outs])
    before = np.cumsum(heads)
    places = heads + np.bincount(of, minlength=len(blocks)) + 4 * np.bincount(of_copy, minlength=len(blocks))
    values, sizes = np.zeros((2, int(places.sum())), np.int64)
    k = np.arange(before[-1]) + np.repeat(np.cumsum(places) - places - before + heads, heads)
    values[k], sizes[k] = [v for out in outs for v in out.few], [v for out in outs for v in out.few_sizes]
    code = codes.reshape(-1).take(symbols)
    k = np.arange(len(where)) + np.repeat(np.arange(0, 4 * m + 4, 4), gaps) + before.take(of)
    values[k], sizes[k] = code >> 4, code & 15
    code, far_code = codes.reshape(-1).take(n_place), far_codes.reshape(-1).take(far_place)
    k = (np.cumsum(gaps)[:-1] + 4 * np.arange(m) + before.take(of_copy))[:, None] + np.arange(4)
    values[k] = np.stack([code >> 4, n_extra, far_code >> 4, far_extra], axis=1)
    sizes[k] = np.stack([code & 15, n_size, far_code & 15, far_size], axis=1)
    return [_file(x) for x in _packed(values, sizes, places)]


#: Bytes of texts that are worked at together; a longer text is alone.
TOGETHER = 1 << 16


def store_many(texts: list[str | None]) -> list[tuple[int, bytes]]:
    """Of each text the number of its bytes, and the files that hold them."""
    sizes, parts, blocks, made, held = [], [], [], [], 0
    most = ROW * MOST_SIDE
    for text in texts:
        x = (text or "").encode()
        sizes.append(len(x))
        x += bytes(-len(x) % ROW if x else ROW)
        parts.append(-(-len(x) // most))
        for k in range(0, len(x), most):
            block = x[k : k + most]
            if blocks and held + len(block) > TOGETHER:
                made += encode_blocks(blocks)
                blocks, held = [], 0
            blocks.append(block)
            held += len(block)
    if blocks:
        made += encode_blocks(blocks)
    files_of = iter(made)
    return [(n, b"".join(next(files_of) for _ in range(k))) for n, k in zip(sizes, parts, strict=True)]


def store(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and the files that hold them."""
    return store_many([text])[0]


def files(media: bytes) -> Iterator[bytes]:
    """The files stored end to end."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at:end]
        at = end


def planes(media: bytes) -> Iterator[np.ndarray]:
    """The grey levels of files stored end to end."""
    for data in files(media):
        yield (image(data) >> np.uint32(8)).astype(np.uint8)


def feature(rows: np.ndarray) -> str:
    """An average hash of 8 x 8 cells, with the mean grey level."""
    return features([rows])[0]


def features(images: list[np.ndarray]) -> list[str]:
    """``feature`` of each image, worked at together."""
    n = np.array([len(x) for x in images])
    rows = np.concatenate(images)
    at = np.arange(9) * n[:, None] >> 3
    first = np.cumsum(n) - n
    # of fewer than eight rows, a cell without one has the row at its place
    sums = np.add.reduceat(rows, (first[:, None] + at[:, :-1]).reshape(-1), axis=0, dtype=np.int64).reshape(-1, 8, 8, 8).sum(axis=3)
    cells = (sums / (8 * np.maximum(np.diff(at), 1))[:, :, None]).reshape(-1, 64)
    hashes = np.packbits(cells > cells.mean(axis=1, keepdims=True), axis=1).tobytes().hex()
    means = np.add.reduceat(rows.sum(axis=1), first) / (ROW * n)
    return [f"{hashes[16 * k : 16 * k + 16]}:{mean:.3f}" for k, mean in enumerate(means.tolist())]


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the stored form of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for k in range(0, len(ids), 256):
                got = store_many(column(batch, "text").slice(k, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(k, 256), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: digests and a feature."""
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(n, k) for n, k in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size, hashes = [], [], 0, []
            for m in column(batch, "media"):
                m = m.as_py()
                rows = np.concatenate(list(planes(m)))
                payload = rows.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(m), hashlib.sha256(m).hexdigest()))
                held.append(rows)
                size += len(payload)
                if size >= TOGETHER:
                    hashes += features(held)
                    held, size = [], 0
            hashes += features(held) if held else []
            out = [(*x, h) for x, h in zip(out, hashes, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=schema.names)

    return media.mapInArrow(run, schema)


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written as a table first; what is read is that table."""
    return read_media(written(store_texts(load(spark, sf_dir)), "media"))
