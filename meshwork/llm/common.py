"""Pieces that several training-data operators share: memory of the worker
processes, and vectorised splitting and hashing of words over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import fresh_path, shared_dir, written

__all__ = ["LOWER", "SPACE", "SPACE_BYTES", "UPPER", "add_at", "boxed", "column", "fresh_path", "lean", "load", "map_arrow", "mix64", "per_row", "pieces", "release", "shared_dir", "unboxed", "word_hashes", "word_spans", "written"]

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not the GNU C library
    _TRIM = None

#: The white space of every contract: blank and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text that numpy works on at once; a longer single text is one piece.
PIECE_BYTES = 1 << 20


def release() -> None:
    """Gives memory that this worker process holds but does not use back to the
    system: Arrow's pool, and the C library's heap where it can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable) -> Callable:
    """For functions of Arrow batches: after a task the process, which Spark
    keeps for later tasks of any stage, holds no more memory than before."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for columns of any name, dots included."""
    names = df.columns

    @functools.wraps(run)
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def boxed(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others, whatever their names, as ``__box``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*own, F.struct(*(rest or [F.lit(None).cast("string").alias("none")])).alias("__box"))


def unboxed(df: DataFrame, columns: list[str], own: tuple[str, ...], made: dict[str, Column] | None = None) -> DataFrame:
    """The columns that ``boxed`` had, in their order; ``made`` follow and take
    the place of those with their names."""
    made = made or {}
    back = [F.col(c) if c in own else F.col("__box")[c].alias(c) for c in columns if c not in made]
    return df.select(*back, *(c.alias(n) for n, c in made.items()))


def pieces(col: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string array into runs of rows of about ``most`` bytes.  Yields
    the first row, the row after the last, their UTF-8 bytes, and offsets into
    these (one more than rows).  Null is empty."""
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_WORD = ~_IS_SPACE
_rng = np.random.Generator(np.random.PCG64(20240917))
_PLACES = 4096
#: Random multipliers by place in the word, and random values by byte.
_BY_PLACE = _rng.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_BYTE[np.frombuffer(UPPER.encode(), np.uint8)] = _BY_BYTE[np.frombuffer(LOWER.encode(), np.uint8)]
_RAW_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a piece, and the words of each row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans`` and a 64-bit hash of each word, with A-Z lower-cased if
    ``fold``.  The hash is multilinear with random coefficients by place, then
    mixed, so that it is the same in every task."""
    starts, ends, per_row = word_spans(data, offs)
    if not len(starts):
        return starts, ends, per_row, np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    value = (_BY_BYTE if fold else _RAW_BYTE)[data[_WORD[data]]]
    value *= _BY_PLACE[place & (_PLACES - 1)]
    if int(lens.max()) > _PLACES:
        value *= (place // _PLACES * 2 + 1).astype(np.uint64)
    return starts, ends, per_row, mix64(np.add.reduceat(value, begin) + lens.astype(np.uint64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def add_at(into: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """into[keys] += values, rows of values, also where keys repeat."""
    for k in range(values.shape[1]):
        into[:, k] += np.bincount(keys, values[:, k], minlength=len(into)).astype(into.dtype)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]
