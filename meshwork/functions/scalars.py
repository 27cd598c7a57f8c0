"""Scalar expressions: owners and places under the partitionings, the process
grid, and the performance figures of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_GBS = 933.1


def grid(parts: int) -> tuple[int, int]:
    """Rows and columns of the process grid: the largest divisor up to the root."""
    rows = max(d for d in range(1, int(parts**0.5) + 1) if parts % d == 0)
    return rows, parts // rows


def grid_rows(parts: Column) -> Column:
    """``grid`` for a column: its number of rows."""
    return F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(parts)).cast("int")), lambda d: parts % d == 0))


def cyclic(i: Column, parts: int) -> tuple[Column, Column]:
    """Owner and local index of a row dealt in turn."""
    return F.pmod(i, F.lit(parts)).cast("int"), F.floor(i / parts).cast("long")


def cyclic_inverse(owner: Column, local: Column, parts: int) -> Column:
    return local * parts + owner


def local_rows(n: int, parts: int, part: int) -> int:
    return n // parts + (part < n % parts)


def block_starts(n: int, parts: int) -> list[int]:
    starts = [0]
    for p in range(parts):
        starts.append(starts[-1] + local_rows(n, parts, p))
    return starts


def block(i: Column, n: int, parts: int) -> tuple[Column, Column]:
    """Owner and local index in contiguous blocks, in closed form: the first
    n mod parts blocks have one row more."""
    small, more = n // parts, n % parts
    edge = more * (small + 1)
    owner = F.when(i < edge, F.floor(i / (small + 1))).otherwise(more + F.floor((i - edge) / max(1, small))).cast("int")
    start = owner * small + F.least(owner, F.lit(more))
    return owner, (i - start).cast("long")


def almost_equal(a: Column, b: Column, atol: float = 1e-2, rtol: float = 1e-2) -> Column:
    gap = F.abs(a - b)
    return (gap <= atol) | (gap <= rtol * F.greatest(F.abs(a), F.abs(b)))


def gflops(nnz: Column, ms: Column) -> Column:
    return F.try_divide(nnz * 2.0, ms * 1e6)


def bytes_moved(nnz: Column, rows: Column, cols: Column, tiles: Column | None = None) -> Column:
    """Values and columns of the entries, row pointers, x and y, four bytes
    each; an entry-balanced kernel also writes its breakpoints."""
    plain = nnz * 8 + (rows + 1) * 4 + cols * 4 + rows * 4
    return plain if tiles is None else plain + tiles * 4


def bandwidth(moved: Column, ms: Column) -> Column:
    return F.when(ms > 0, moved / (ms * 1e6)).otherwise(0.0)


def percent_of_peak(gbs: Column, peak: float = PEAK_GBS) -> Column:
    return gbs * 100.0 / peak


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def expected_ghost_fraction(per_row: float, parts: Column) -> Column:
    return 1 - F.exp(-F.lit(float(per_row)) / parts)
