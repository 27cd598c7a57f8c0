"""Blocked sparse storage: a matrix as compressed-row blocks in a Parquet table
with a catalog, so that a product over a range of rows and columns reads only
the blocks that it needs.

A block holds the entries of ``size`` rows and ``size`` columns as arrays: the
rows that have entries, where each begins, and the columns and values.  A block
of more than ``PIECE`` entries is several rows of the table, dealt by row and
column, so that no row of it grows without bound.  Blocks are stored by bands of
``BAND`` block rows (a directory each: row ranges prune directories) and sorted
within, so that the statistics of row groups prune column ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import ShapeError, SparseMatrix

SIZE, BAND, PIECE = 4096, 16, 100_000
_KEY = ("band", "bi", "bj", "piece")


def blocked(m: SparseMatrix, size: int = SIZE, band: int = BAND, piece: int = PIECE) -> DataFrame:
    """The rows of the block table: band, bi, bj, piece, nnz, the first and last
    row and column with entries, rows, starts, cols and vals (local indices)."""
    at = m.df.select(F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), (F.col("i") % size).cast("int").alias("li"), (F.col("j") % size).cast("int").alias("lj"), "v")
    large = at.groupBy("bi", "bj").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    at = at.join(large, ["bi", "bj"], "left").withColumn("piece", F.pmod(F.xxhash64("li", "lj", "v"), F.coalesce("pieces", F.lit(1))).cast("int"))
    rows = at.groupBy("bi", "bj", "piece", "li").agg(F.array_sort(F.collect_list(F.struct("lj", "v"))).alias("row"))
    b = rows.groupBy("bi", "bj", "piece").agg(F.array_sort(F.collect_list(F.struct("li", "row"))).alias("rows"))
    sizes = F.transform("rows", lambda r: F.size(r["row"]))
    cells = F.flatten(F.transform("rows", lambda r: r["row"]))
    # starts: the entries before each row, and in all
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    b = b.select("bi", "bj", "piece", F.transform("rows", lambda r: r["li"]).alias("rows"), starts.alias("starts"), F.transform(cells, lambda c: c["lj"]).alias("cols"), F.transform(cells, lambda c: c["v"]).alias("vals"))
    low, high = lambda c: F.array_min(c), lambda c: F.array_max(c)
    return b.select(
        F.floor(F.col("bi") / band).cast("int").alias("band"), "bi", "bj", "piece", F.size("cols").alias("nnz"),
        (F.col("bi") * size + low("rows")).alias("row_lo"), (F.col("bi") * size + high("rows")).alias("row_hi"), (F.col("bj") * size + low("cols")).alias("col_lo"), (F.col("bj") * size + high("cols")).alias("col_hi"),
        "rows", "starts", "cols", "vals",
    )


def write(m: SparseMatrix, path: str, size: int = SIZE, band: int = BAND, piece: int = PIECE) -> None:
    """The block table below ``path``/blocks, its shape and sizes beside it."""
    blocks = blocked(m, size, band, piece)
    blocks.repartitionByRange("band", "bi", "bj").sortWithinPartitions("bi", "bj").write.partitionBy("band").parquet(f"{path}/blocks")
    m.df.sparkSession.createDataFrame([(m.nrows, m.ncols, size, band)], "nrows long, ncols long, size int, band int").coalesce(1).write.parquet(f"{path}/shape")


class Blocks:
    """A stored matrix; nothing but its shape is read until it is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        shape = spark.read.parquet(f"{path}/shape").first()
        self.nrows, self.ncols, self.size, self.band = shape
        self.table = spark.read.parquet(f"{path}/blocks")

    def catalog(self) -> DataFrame:
        """One row for each block: its ranges and entries, without the arrays."""
        return self.table.groupBy("bi", "bj").agg(F.sum("nnz").alias("nnz"), *(f(c).alias(c) for c, f in (("row_lo", F.min), ("row_hi", F.max), ("col_lo", F.min), ("col_hi", F.max))))

    def within(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """The blocks that may have entries in the half-open ranges: bands are
        directories, the other conditions reach the scan."""
        out = self.table
        for bounds, block, low, high, n in ((rows, "bi", "row_lo", "row_hi", self.nrows), (cols, "bj", "col_lo", "col_hi", self.ncols)):
            if bounds is None:
                continue
            a, b = bounds
            if not 0 <= a <= b <= n:
                raise ShapeError(f"{a} to {b} is no range of {n}")
            if block == "bi":
                out = out.filter(F.col("band").between(a // self.size // self.band, max(b - 1, 0) // self.size // self.band))
            out = out.filter(F.col(block).between(a // self.size, max(b - 1, 0) // self.size) & (F.col(high) >= a) & (F.col(low) < b))
        return out

    def entries(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """The entries (i, j, v) in the ranges."""
        row = lambda k: F.slice(F.arrays_zip("cols", "vals"), F.element_at("starts", k + 1) + 1, F.element_at("starts", k + 2) - F.element_at("starts", k + 1))
        each = self.within(rows, cols).select("bi", "bj", "starts", "cols", "vals", F.posexplode("rows").alias("k", "li"))
        each = each.select("bi", "bj", "li", F.inline(row(F.col("k"))))
        out = each.select((F.col("bi") * self.size + F.col("li")).alias("i"), (F.col("bj") * self.size + F.col("cols")).alias("j"), F.col("vals").alias("v"))
        for bounds, c in ((rows, "i"), (cols, "j")):
            if bounds is not None:
                out = out.filter((F.col(c) >= bounds[0]) & (F.col(c) < bounds[1]))
        return out

    def matrix(self) -> SparseMatrix:
        return SparseMatrix(self.entries(), self.nrows, self.ncols)

    def product(self, x: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """(i, y) of A x over the ranges, for rows with entries in them."""
        a = self.entries(rows, cols)
        return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
