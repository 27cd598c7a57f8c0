"""Sparse matrix-vector product: a join of the entries with x, summed by row.

The plans move data differently and give the same rows:

- ``plain``: Spark picks the join.
- ``broadcast``: x goes to every task, if it is small enough to (its rows are
  known: ``BROADCAST_ROWS``); else as ``plain``.
- ``ghost``: only the entries of x that a part refers to and does not own go to it.
- ``checkerboard``: x segments go down grid columns, partial sums across rows.

Kernels: ``line`` sums by row; ``flat`` divides rows of more than ``TILE``
entries into tiles of about so many, sums these and then the row, so that no row
is one task's work; the others keep their map-side sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, grid
from .matrix import SparseMatrix, row_stats
from .partition import checkerboard

BROADCAST_ROWS = 1_000_000
TILE = 1024
#: Fixed values of the kernel choice.
FLAT_NNZ, FLAT_IMBALANCE, FLAT_AVG, ALWAYS_FLAT_AVG = 1_000_000, 32, 8, 128


def _summed(products: DataFrame, kernel: str, rows: DataFrame) -> DataFrame:
    """Products (i, j, xv) summed by row; ``rows``: the entries' i."""
    if kernel != "flat":
        return products.groupBy("i").agg(F.sum("xv").alias("y"))
    # at most nnz / TILE rows are longer than a tile; only these are divided
    hubs = rows.groupBy("i").agg(F.ceil(F.count("*") / TILE).alias("tiles")).filter("tiles > 1")
    tile = F.coalesce(F.pmod(F.xxhash64("j", "xv"), F.col("tiles")), F.lit(0))
    tiles = products.join(hubs, "i", "left").groupBy("i", tile.alias("tile")).agg(F.sum("xv").alias("xv"))
    return tiles.groupBy("i").agg(F.sum("xv").alias("y"))


def dense(y: DataFrame, nrows: int) -> DataFrame:
    """Rows without entries get 0."""
    rows = y.sparkSession.range(nrows).withColumnRenamed("id", "i")
    return rows.join(y, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def spmv(m: SparseMatrix, x: DataFrame, exchange: str = "plain", kernel: str = "line", parts: int = 4, assignment: DataFrame | None = None) -> DataFrame:
    """i and y = A x for every row with entries.  ``assignment`` (g, owner)
    replaces the dealing of rows in turn in the ghost exchange."""
    a = m.df
    if exchange in ("plain", "broadcast"):
        side = F.broadcast(x) if exchange == "broadcast" and m.ncols <= BROADCAST_ROWS else x
        return _summed(a.join(side, "j").select("i", "j", (F.col("v") * F.col("x")).alias("xv")), kernel, a)
    m.square()
    if exchange == "checkerboard":
        rows, cols = grid(parts)
        pc, lj = cyclic(F.col("j"), cols)
        segments = x.select(pc.alias("pc"), lj.alias("lj"), "x").withColumn("pr", F.explode(F.array(*map(F.lit, range(rows)))))
        part = checkerboard(a, parts).join(segments, ["pr", "pc", "lj"]).groupBy("pr", "pc", "li").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        total = part.groupBy("pr", "li").agg(F.sum("y").alias("y"))
        return total.select((F.col("li") * rows + F.col("pr")).cast("long").alias("i"), "y")
    if exchange != "ghost":
        raise ValueError(f"unknown exchange {exchange}")
    if assignment is None:
        owner = lambda c: cyclic(F.col(c), parts)[0]
        own = a.withColumn("p", owner("i"))
        xs = x.withColumn("owner", owner("j"))
    else:
        who = assignment.select("g", "owner")
        own = a.join(who.select(F.col("g").alias("i"), F.col("owner").alias("p")), "i")
        xs = x.join(who.withColumnRenamed("g", "j"), "j")
    need = own.select("p", "j").distinct()  # owned columns and ghosts
    local = xs.join(need, "j").select("p", "j", "x")
    return _summed(own.join(local, ["p", "j"]).select("i", "j", (F.col("v") * F.col("x")).alias("xv")), kernel, a)


def kernel_choice(m: SparseMatrix) -> DataFrame:
    """One row: the row statistics, the kernel, and threads a row of ``line``."""
    s = row_stats(m)
    flat = ((F.col("nnz") > FLAT_NNZ) & ((F.col("imbalance") > FLAT_IMBALANCE) | (F.col("avg_row") > FLAT_AVG))) | (F.col("avg_row") > ALWAYS_FLAT_AVG)
    lanes = F.when(F.col("avg_row") >= 24, 4).when(F.col("avg_row") >= 8, 2).otherwise(1)
    return s.select("*", F.when(flat, "flat").otherwise("line").alias("kernel"), lanes.alias("lanes"))


def chosen_kernel(m: SparseMatrix) -> str:
    return kernel_choice(m).first()["kernel"]


def breakpoints(m: SparseMatrix, tile: int = TILE) -> DataFrame:
    """First row of every tile of ``tile`` entries in row order."""
    from ..functions.tables import ranked

    counts = m.df.groupBy("i").agg(F.count("*").alias("nnz"))
    placed = ranked(counts, [F.col("i")], "before", F.col("nnz"))
    # tiles that begin within a row, and the one that the row continues
    tiles = F.sequence(F.floor(F.col("before") / tile), F.floor((F.col("before") + F.col("nnz") - 1) / tile))
    return placed.select("i", F.explode(tiles).alias("tile")).groupBy("tile").agg(F.min("i").alias("first_row"))


def compare(y1: DataFrame, y2: DataFrame, atol: float = 1e-2, rtol: float = 1e-2) -> DataFrame:
    """i, both values (0 where missing) and whether they are almost equal."""
    from ..functions.scalars import almost_equal

    both = y1.select("i", F.col("y").alias("y1")).join(y2.select("i", F.col("y").alias("y2")), "i", "full_outer")
    both = both.select("i", F.coalesce("y1", F.lit(0.0)).alias("y1"), F.coalesce("y2", F.lit(0.0)).alias("y2"))
    return both.withColumn("ok", almost_equal(F.col("y1"), F.col("y2"), atol, rtol))


def mismatches(y1: DataFrame, y2: DataFrame, most: int = 10, **tol: float) -> DataFrame:
    """The first mismatches by row: a report of at most ``most`` rows."""
    return compare(y1, y2, **tol).filter("NOT ok").orderBy("i").limit(most).select("i", "y1", "y2")


