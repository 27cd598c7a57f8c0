"""Sparse matrix times sparse matrix: the outer products of A's columns with
B's rows, summed by cell.

A key k with a entries in A's column and b in B's row makes a x b products.
Where these are many, both sides are cut: A's entries into ceil(a / ``CELL``)
pieces, B's into ceil(b / ``CELL``), each piece being copied to all of the other
side, so that no row below holds more than about ``CELL`` entries of a side.

Products are never shuffled.  Rows of the result are dealt to parts, ranges of
rows with about ``PART`` products each; a range that has more by itself is
divided by columns too.  Of each key, a part gets the entries of A in its rows
with B's row once for all of them, packed into the narrowest types that hold
them, and makes and sums the products a few rows at a time.  So what is shuffled
are entries, at most one of B for each product and far fewer where the rows of
a range share keys.  The number of products is known before any is made
(``products``).

Packing is for whole numbers as indices and doubles as values; matrices of other
types are joined and summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import ranges
from ..functions.tables import written
from .matrix import ShapeError, SparseMatrix

CELL = 4096
#: Products of a part, and ranges of rows of which their numbers are known.
PART, RANGES = 1 << 22, 1 << 14
#: Products made at a time (by one entry of A at least), and entries held unsummed.
STEP, HELD = 1 << 21, 6_000_000
#: Stands for a null index and (these bits) for a null value.
NO_INDEX, NO_VALUE = -(1 << 63), 0x7FF8_0000_DEAD_0001
INTS = (np.uint8, np.uint16, np.uint32, np.uint64)
FLOATS = (np.uint8, np.int16, np.float32, np.float64)


def transposed(m: SparseMatrix) -> SparseMatrix:
    return SparseMatrix(m.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m.ncols, m.nrows)


def _counts(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """k, and how many entries A's column and B's row k have, of keys in both."""
    left = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("a"))
    right = b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("b"))
    return left.join(right, "k")


def products(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row: the keys that meet, the products they make, the most of one key,
    and the cells that the result has at most."""
    n = F.col("a") * F.col("b")
    s = _counts(a, b).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(n), F.lit(0)).alias("n_products"), F.coalesce(F.max(n), F.lit(0)).alias("most"))
    return s.withColumn("most_cells", F.least(F.col("n_products").cast("double"), F.lit(float(a.nrows) * float(b.ncols))))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of (index, value): where each begins (and the last ends), all
    indices, all values."""
    at = lists.offsets.to_numpy()
    x, v = lists.values.flatten()
    bits = np.array(v.fill_null(0.0)).view(np.int64)
    bits[np.asarray(v.is_null())] = NO_VALUE
    return at, x.to_numpy(), bits.view(np.float64)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _packed_ints(x: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, pa.Array]:
    """The type, each list's least number and its numbers above that."""
    least = np.minimum.reduceat(x, np.cumsum(counts) - counts)
    above = x.view(np.uint64) - np.repeat(least, counts).view(np.uint64)
    kind = next(k for k, t in enumerate(INTS) if above.max() <= np.iinfo(t).max)
    return kind, least, _binary(above.astype(INTS[kind]), counts)


def _packed_floats(v: np.ndarray, counts: np.ndarray) -> tuple[int, pa.Array]:
    """Bit by bit the same in the narrowest type."""
    with np.errstate(all="ignore"):
        kind = next(k for k, t in enumerate(FLOATS) if t is np.float64 or (v.astype(t).astype(np.float64).view(np.int64) == v.view(np.int64)).all())
        return kind, _binary(v.astype(FLOATS[kind]), counts)


MESSAGE = "part int, kinds int, x0 long, j0 long, xs binary, vs binary, js binary, ws binary"


def _messages(batches: Iterator[pa.RecordBatch], width: int, first: np.ndarray, pieces: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """For each row of lists and each part that takes some of the left one: these
    entries, and the right list (of a part that is a piece of columns, its own)."""
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    for batch in batches:
        la, x, v = _flat(batch.column(0))
        ra, j, w = _flat(batch.column(1))
        row = np.repeat(np.arange(len(la) - 1), np.diff(la))
        x, v = x[la[0] : la[-1]], v[la[0] : la[-1]]
        lengths = np.diff(ra)
        # a left entry takes its row's right list along at most as often as its range has pieces
        most = np.cumsum(lengths[row] * pieces[_bucket(x, width, len(first))])
        begin = 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(most, (most[begin - 1] if begin else 0) + step, "right")))
            some = slice(begin, end)
            begin = end
            bucket = _bucket(x[some], width, len(first))
            n = pieces[bucket]
            part = ranges(first[bucket], n)
            own, r = np.repeat(np.arange(some.start, some.stop), n), np.repeat(row[some], n)
            q, piece = np.repeat(n, n), ranges(np.zeros(len(n), np.int64), n)
            order = np.lexsort((part, r))
            own, r, part, q, piece = (c[order] for c in (own, r, part, q, piece))
            heads = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (part[1:] != part[:-1]))))
            n_left = np.diff(np.append(heads, len(r)))
            n_right = lengths[r[heads]]
            at = ranges(ra[r[heads]], n_right)
            message = np.repeat(np.arange(len(heads)), n_right)
            if (q[heads] > 1).any():
                mine = _column_piece(j[at], q[heads][message]) == piece[heads][message]
                at, message = at[mine], message[mine]
                n_right = np.bincount(message, minlength=len(heads))
            full = n_right > 0
            if not full.all():
                own, heads, n_left, n_right = own[np.repeat(full, n_left)], heads[full], n_left[full], n_right[full]
            if not len(heads):
                continue
            kx, x0, xs = _packed_ints(x[own], n_left)
            kj, j0, js = _packed_ints(j[at], n_right)
            kv, vs = _packed_floats(v[own], n_left)
            kw, ws = _packed_floats(w[at], n_right)
            kinds = np.full(len(heads), ((kx * 4 + kv) * 4 + kj) * 4 + kw, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(kinds), pa.array(x0), pa.array(j0), xs, vs, js, ws], names)


def _bucket(x: np.ndarray, width: int, n: int) -> np.ndarray:
    return np.clip(x // width, 0, n - 1)


def _column_piece(j: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    mixed = j.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % pieces.astype(np.uint64)).astype(np.int64)


class _Held:
    """Messages of a part, unpacked: left entries (x, v, where their right list
    is in j, w, and its length)."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.lefts: list[tuple[np.ndarray, ...]] = []
        self.n_left = self.n_right = 0

    def add(self, batch: pa.RecordBatch) -> None:
        every = batch.column(1).to_numpy()
        for kinds in np.unique(every):
            some = batch.take(pa.array(np.flatnonzero(every == kinds)))
            kinds, kw = divmod(int(kinds), 4)
            kinds, kj = divmod(kinds, 4)
            kx, kv = divmod(kinds, 4)
            (n, x), (_, v), (m, j), (_, w) = (self._of(some.column(k), t) for k, t in ((4, INTS[kx]), (5, FLOATS[kv]), (6, INTS[kj]), (7, FLOATS[kw])))
            x = (x.astype(np.uint64) + np.repeat(some.column(2).to_numpy(), n).view(np.uint64)).view(np.int64)
            j = (j.astype(np.uint64) + np.repeat(some.column(3).to_numpy(), m).view(np.uint64)).view(np.int64)
            self.lefts.append((x, v.astype(np.float64), np.repeat(self.n_right + np.cumsum(m) - m, n), np.repeat(m, n)))
            self.parts.append((j, w.astype(np.float64)))
            self.n_left += len(x)
            self.n_right += len(j)

    @staticmethod
    def _of(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]]
        return np.diff(at).astype(np.int64) // np.dtype(kind).itemsize, data.view(kind)

    def cells(self, step: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The sums of all cells in their order, a few rows of them at a time."""
        if not self.n_left:
            return
        x, v, at, n = (np.concatenate(c) for c in zip(*self.lefts, strict=True))
        j, w = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(x, kind="stable")
        x, v, at, n = x[order], v[order], at[order], n[order]
        made, begin, kept = np.cumsum(n), 0, None
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(made, (made[begin - 1] if begin else 0) + step, "right")))
            many, right = n[begin:end], ranges(at[begin:end], n[begin:end])
            a, b = np.repeat(v[begin:end], many), w[right]
            there = (a.view(np.int64) != NO_VALUE) & (b.view(np.int64) != NO_VALUE)
            with np.errstate(all="ignore"):
                new = (np.repeat(x[begin:end], many), j[right], np.where(there, a * b, 0.0), there)
            done = _summed(new if kept is None else tuple(np.concatenate(c) for c in zip(kept, new, strict=True)))
            # the last row may go on
            cut = int(np.searchsorted(done[0], x[end - 1])) if end < len(x) else len(done[0])
            kept = tuple(c[cut:] for c in done)
            yield tuple(c[:cut] for c in done)
            begin = end


def _summed(cells: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows, columns, sums and whether any value is there, ordered; each cell once."""
    x, j, v, there = cells
    if not len(x):
        return cells
    x0, j0 = int(x.min()), int(j.min())
    span = int(j.max()) - j0 + 1
    if (int(x.max()) - x0 + 1) * span < 1 << 62:
        order = np.argsort((x - x0) * span + (j - j0), kind="stable")
    else:
        order = np.lexsort((j, x))
    x, j = x[order], j[order]
    heads = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (j[1:] != j[:-1]))))
    with np.errstate(all="ignore"):
        return x[heads], j[heads], np.add.reduceat(v[order], heads), np.logical_or.reduceat(there[order], heads)


def _part(batches: Iterator[pa.RecordBatch], step: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The sums of a part's cells, each once."""
    held, before = _Held(), None
    for batch in batches:
        if batch.num_rows:
            held.add(batch)
        if held.n_left + held.n_right > most:
            # more than a part has by plan: few cells with many products
            now = [tuple(np.concatenate(c) for c in zip(*held.cells(step), strict=True)), *([before] if before else [])]
            before, held = _summed(tuple(np.concatenate(c) for c in zip(*now, strict=True))), _Held()
    if before is None:
        yield from held.cells(step)
    else:
        yield _summed(tuple(np.concatenate(c) for c in zip(before, *held.cells(step), strict=True)))


def _dealt(weights: dict[int, int], parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each range of rows its first part and how many it has, and the number
    of parts.  Neighbours share a part while their products are few enough."""
    most = min(max(sum(weights.values()) // parts, STEP // 2), PART)
    first, pieces, at, filled = np.zeros(RANGES, np.int64), np.ones(RANGES, np.int64), 0, 0
    for k in range(RANGES):
        n = weights.get(k, 0)
        if filled and filled + n > most:
            at, filled = at + 1, 0
        first[k] = at
        if n > most:
            pieces[k] = -(-n // most)
            at += int(pieces[k])
        else:
            filled += n
    return first, pieces, at + 1


def pieces(side: DataFrame, cut: DataFrame, own: str, other: str) -> DataFrame:
    """``side`` with the piece that each entry is in, once for each of the other's."""
    some = side.join(cut, "k", "left")
    mine = F.pmod(F.xxhash64("x", "v"), F.coalesce(own, F.lit(1))).cast("int")
    some = some.withColumn(f"{own}_at", mine)
    return some.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("pa", "pb")


def spmm(a: SparseMatrix, b: SparseMatrix, cell: int = CELL) -> SparseMatrix:
    """A B with one entry for each cell that any product falls into."""
    if a.ncols != b.nrows:
        raise ShapeError(f"{a.nrows} x {a.ncols} times {b.nrows} x {b.ncols}")
    left, right = (side.select(F.col(k).alias("k"), F.col(x).alias("x"), "v").filter("k IS NOT NULL") for side, k, x in ((a.df, "j", "i"), (b.df, "i", "j")))
    same = left.sameSemantics(right)  # as in a product with the transpose
    keys = ["k"]
    # only keys beyond a cell are cut: at most entries / cell of them
    many = [side.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("k") for side in ((left,) if same else (left, right))]
    hot = written(many[0] if same else many[0].union(many[1]).distinct(), "spmm-hot")
    if not hot.isEmpty():
        few = [side.join(hot, "k", "left_semi").groupBy("k").agg(F.ceil(F.count("*") / cell).cast("int").alias(p)) for side, p in ((left, "pa"), (right, "pb"))]
        cut = written(few[0].join(few[1], "k"), "spmm-cut")
        left, right = pieces(left, cut, "pa", "pb"), pieces(right, cut, "pb", "pa")
        keys, same = ["k", "pa_at", "pb_at"], False
    row, column = a.df.schema["i"].dataType, b.df.schema["j"].dataType
    if not (isinstance(row, T.IntegralType) and isinstance(column, T.IntegralType) and all(isinstance(m.df.schema["v"].dataType, T.DoubleType) for m in (a, b))):
        out = left.select(*keys, F.col("x").alias("i"), F.col("v").alias("va")).join(right.select(*keys, F.col("x").alias("j"), F.col("v").alias("vb")), keys)
        return SparseMatrix(out.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v")), a.nrows, b.ncols)

    n = int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index: Column = F.coalesce(F.col("x").cast("long"), F.lit(NO_INDEX))

    def lists(side: DataFrame, name: str) -> DataFrame:
        return side.repartition(n, *keys).groupBy(*keys).agg(F.collect_list(F.struct(index.alias("x"), "v")).alias(name))

    met = lists(left, "l").select("l") if same else lists(left, "l").join(lists(right, "r"), keys).select("l", "r")
    met = written(met, "spmm-met").select("l", F.col("l" if same else "r").alias("r"))
    width = max(1, -(-a.nrows // RANGES))
    bucket = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("x") / width))).cast("int")
    made = met.select(F.explode(F.col("l")["x"]).alias("x"), F.size("r").alias("n")).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    first, split, parts = _dealt(dict(map(tuple, made.collect())), n)  # a row for each of RANGES at most

    step, held = STEP, HELD

    def message(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _messages(batches, width, first, split, step)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, j, v, there in _part(batches, step, held):
            for k in range(0, len(x), 1 << 16):
                i, j_, v_, no = x[k : k + (1 << 16)], j[k : k + (1 << 16)], v[k : k + (1 << 16)], ~there[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(i, mask=i == NO_INDEX), pa.array(j_, mask=j_ == NO_INDEX), pa.array(v_, mask=no)], ["i", "j", "v"])

    out = met.mapInArrow(message, MESSAGE).repartitionById(parts, "part").mapInArrow(cells, "i long, j long, v double")
    return SparseMatrix(out.select(F.col("i").cast(row), F.col("j").cast(column), "v"), a.nrows, b.ncols)
