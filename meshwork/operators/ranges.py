"""Range join: points with the intervals [low, high) that hold them.

The line of numbers is cut into cells at quantiles of the points and of the
intervals' beginnings, about ``HOT`` of either to a cell; a value with more has a
cell of its own.  A point is filed once, in its cell, an interval in each cell
with points that it meets: between its first and last it holds all points there,
so that such copies are never more than the pairs.  Cells with more rows or
pairs are cut into pieces on both sides, each piece being copied to all of the
other side, so that no task holds more than about ``HOT`` rows of a side.

Only the filed rows are shuffled.  Within a piece intervals are told apart by
length: one of up to 2**k times the base width lies in at most two bins of that
width, however long it is, and a point looks into its bin of every width that
occurs (at most 64 of them).  Points and intervals of a bin are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import ranges

HOT = 100_000
#: Cells at most of either quantiles; pairs by whole cells that a piece may have.
CELLS, PAIRS = 10_000, 1 << 28
#: Partitions that pieces have at most, unless shuffles have more; rows filed at a time.
PARTS, STEP = 1024, 1 << 16


def base_width(intervals: DataFrame, low: str, high: str) -> float:
    """The median length: half of the intervals are filed by the narrowest bins."""
    width = intervals.filter(F.col(high) > F.col(low)).agg(F.percentile_approx((F.col(high) - F.col(low)).cast("double"), 0.5)).first()[0]
    return float(width or 1.0)


def _bounds(sides: list[Column], df: list[DataFrame], hot: int) -> np.ndarray:
    """Where cells begin, after the first."""
    out, least = [np.zeros(0)], int(df[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for x, side in zip(sides, df, strict=True):
        n = side.count()
        cells = min(max(-(-n // hot), least), CELLS)
        if n and cells > 1:
            at = np.array(side.agg(F.percentile_approx(x, [k / cells for k in range(1, cells)], max(10_000, 20 * cells))).first()[0])  # a value for each cell
            own = at[1:][at[1:] == at[:-1]]  # these values fill cells
            out += [at, np.nextafter(own, np.inf)]
    return np.unique(np.concatenate(out))


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, hot: int = HOT) -> DataFrame:
    """The columns of both sides, one row for each pair with low <= point < high;
    empty intervals and nulls match nothing.  Names must differ between the sides."""
    both = set(points.columns) & set(intervals.columns)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    own, other = ([f"{side}{k}" for k in range(len(df.columns))] for side, df in (("p", points), ("s", intervals)))
    p, s = points.toDF(*own), intervals.toDF(*other)
    x, lo, hi = own[points.columns.index(point)], other[intervals.columns.index(low)], other[intervals.columns.index(high)]
    # NaN is above all numbers: no interval holds it
    p = p.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    s = s.filter(F.col(hi) > F.col(lo))
    as_doubles = [F.col(c).cast("double") for c in (x, lo, hi)]
    bounds = _bounds(as_doubles[:2], [p, s], hot)
    n_cells = len(bounds) + 1

    def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell of rows, by the doubles in front: a point's one, an
        interval's two.  A last point may have been rounded up to the end."""
        first = np.searchsorted(bounds, batch.column("from").to_numpy(), "right")
        return first, np.searchsorted(bounds, batch.column("to").to_numpy(), "right")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell its points, and changes from the cell before in the
        numbers of intervals that meet it and that hold all of it."""
        n = np.zeros((3, n_cells + 1), np.int64)
        add = lambda k, at, by: np.add(n[k], by * np.bincount(at, minlength=n_cells + 1), out=n[k])
        for batch in batches:
            first, last = cells(batch)
            spans = np.asarray(batch.column("is_span"))
            add(0, first[~spans], 1)
            add(1, first[spans], 1)
            add(1, last[spans] + 1, -1)
            far = spans & (last > first)
            add(2, first[far] + 1, 1)
            add(2, last[far], -1)
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(row[some]) for row in n)], ["cell", "own", "met", "full"])

    ends = p.select(as_doubles[0].alias("from"), as_doubles[0].alias("to"), F.lit(False).alias("is_span")).union(s.select(as_doubles[1], as_doubles[2], F.lit(True)))
    n = np.zeros((3, n_cells + 1), np.int64)
    for r in ends.mapInArrow(count, "cell long, own long, met long, full long").groupBy("cell").agg(F.sum("own"), F.sum("met"), F.sum("full")).collect():  # a row for each cell
        n[:, r[0]] = r[1:]
    n_own, n_met, n_full = n[0, :-1], np.cumsum(n[1])[:-1], np.cumsum(n[2])[:-1]
    there = (n_own > 0) & (n_met > 0)
    p_met = np.where(there, -(-n_met // hot), 0)
    pairs = n_own.astype(float) * n_full
    p_own = np.where(there, np.maximum(-(-n_own // hot), np.ceil(pairs / PAIRS / np.maximum(p_met, 1)).astype(np.int64)), 0)
    base = np.cumsum(p_own * p_met) - p_own * p_met
    n_pieces = int((p_own * p_met).sum())

    def file(of_points: bool, columns: list[str]):
        """Rows with the number of each piece that they are filed in."""
        mine, copies = (p_own, p_met) if of_points else (p_met, p_own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first, last = cells(batch)
                hashed, n, begin = batch.column("hashed").to_numpy(), last - first + 1, 0
                made = np.cumsum(n)
                while begin < batch.num_rows:
                    end = max(begin + 1, int(np.searchsorted(made, (made[begin - 1] if begin else 0) + STEP, "right")))
                    row, at = np.repeat(np.arange(begin, end), n[begin:end]), ranges(first[begin:end], n[begin:end])
                    row, at = row[there[at]], at[there[at]]
                    piece, many = hashed[row] % mine[at], copies[at]
                    row, at, piece, copy = np.repeat(row, many), np.repeat(at, many), np.repeat(piece, many), ranges(np.zeros(len(at), np.int64), many)
                    piece = base[at] + (piece * p_met[at] + copy if of_points else copy * p_met[at] + piece)
                    for k in range(0, len(row), STEP):
                        some = batch.take(pa.array(row[k : k + STEP]))
                        yield pa.RecordBatch.from_arrays([pa.array(piece[k : k + STEP].astype(np.int32)), *(some.column(c) for c in columns)], ["piece", *columns])
                    begin = end

        return run

    def filed(df: DataFrame, of_points: bool) -> DataFrame:
        first, last = (as_doubles[0], as_doubles[0]) if of_points else as_doubles[1:]
        schema = T.StructType([T.StructField("piece", T.IntegerType()), *df.schema.fields])
        hashed = F.pmod(F.xxhash64(*df.columns), F.lit((1 << 31) - 1))
        out = df.select("*", first.alias("from"), last.alias("to"), hashed.alias("hashed")).mapInArrow(file(of_points, df.columns), schema)
        return out.repartitionById(parts, "piece")

    parts = max(1, min(n_pieces, max(PARTS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    width = F.lit(base_width(s, lo, hi))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(hi) - F.col(lo)).cast("double") / width))).cast("int")

    def bin_of(at: Column, level: Column) -> Column:
        return F.floor(at.cast("double") / (width * F.pow(F.lit(2.0), level)))

    levels = sorted(r[0] for r in s.select(level).distinct().collect())  # widths: at most 64 or so
    looks = F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))
    asked = filed(p, True).withColumn("level", looks).withColumn("bin", bin_of(F.col(x), F.col("level")))
    spans = filed(s, False).withColumn("level", level)
    spans = spans.withColumn("bin", F.explode(F.sequence(bin_of(F.col(lo), F.col("level")), bin_of(F.col(hi), F.col("level")))))
    out = asked.join(spans, ["piece", "level", "bin"]).filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi)))
    return out.select(*own, *other).toDF(*points.columns, *intervals.columns)
