"""Iterative solvers over a sparse matrix: power iteration, PageRank and
conjugate gradients.

The matrix is laid out once, bucketed and sorted by column, so that a step joins
it with the vector without moving it: only the vector and the partial sums of
rows are shuffled.  A column of more than ``HUB`` entries (a third of them may
be in one) is cut into pieces by row, and its entry of the vector is copied to
each.  A step's vector is a table in the shared folder, where lineage ends, and
convergence is one aggregate over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import bucketed, forget, written
from .matrix import SparseMatrix, adjacency

HUB = 1_000_000
DAMPING = 0.85


@dataclass(frozen=True)
class ColumnStore:
    """Entries (j, piece, i, v) bucketed by (j, piece), and the cut columns."""

    entries: DataFrame
    hubs: DataFrame
    n: int

    def times(self, x: DataFrame) -> DataFrame:
        """(i, y) of A x for rows with entries, x being (j, x)."""
        spread = x.join(self.hubs, "j", "left").select("j", "x", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
        return self.entries.join(spread, ["j", "piece"]).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def stored_by_column(m: SparseMatrix, hub: int = HUB) -> ColumnStore:
    """``m`` laid out for many products; equal cells are added up."""
    entries = m.square().df.groupBy("i", "j").agg(F.sum("v").alias("v"))
    # at most entries / hub columns are cut
    hubs = written(entries.groupBy("j").agg(F.ceil(F.count("*") / hub).cast("int").alias("pieces")).filter("pieces > 1"), "hubs")
    piece = F.pmod(F.xxhash64("i"), F.coalesce("pieces", F.lit(1))).cast("int")
    return ColumnStore(bucketed(entries.join(hubs, "j", "left").select("j", piece.alias("piece"), "i", "v"), ("j", "piece"), "columns"), hubs, m.nrows)


def _dot(x: DataFrame, *products: Column) -> tuple[float, ...]:
    return tuple(v or 0.0 for v in x.agg(*(F.sum(p) for p in products)).first())


def _step(df: DataFrame, name: str, was: DataFrame | None) -> DataFrame:
    """The next vector as a table; the one before the last is let go."""
    out = written(df, name)
    if was is not None:
        forget(was)
    return out


def power_iteration(m: SparseMatrix, steps: int = 100, tol: float = 1e-9) -> tuple[DataFrame, float]:
    """(j, x) of unit length and the eigenvalue of largest modulus, from the
    vector of ones; ends when the eigenvalue moves by less than ``tol`` of it."""
    a, value = stored_by_column(m), 0.0
    x, old = written(m.df.sparkSession.range(m.nrows).select(F.col("id").alias("j"), F.lit(m.nrows**-0.5).alias("x")), "vector"), None
    for _ in range(steps):
        y = x.join(a.times(x).withColumnRenamed("i", "j"), "j", "left").select("j", "x", F.coalesce("y", F.lit(0.0)).alias("y"))
        y = written(y, "product")
        now, norm2 = _dot(y, F.col("x") * F.col("y"), F.col("y") * F.col("y"))
        if norm2 == 0:
            return x, 0.0
        x, old = _step(y.select("j", (F.col("y") / F.lit(norm2**0.5)).alias("x")), "vector", old), x
        forget(y)
        done, value = abs(now - value) <= tol * abs(now), now
        if done:
            break
    return x, value


def pagerank(m: SparseMatrix, steps: int = 100, tol: float = 1e-10, damping: float = DAMPING) -> DataFrame:
    """(j, rank) of the graph whose edges are the distinct cells i -> j; vertices
    without edges share their rank with all.  Ends when the ranks move by less
    than ``tol`` in all."""
    spark, n = m.df.sparkSession, m.nrows
    edges = m.square().df.select("i", "j").distinct()
    out = written(edges.groupBy("i").agg(F.count("*").alias("degree")), "degrees")
    share = edges.join(out, "i").select(F.col("j").alias("i"), F.col("i").alias("j"), (1.0 / F.col("degree")).alias("v"))
    a = stored_by_column(SparseMatrix(share, n, n))
    ends = out.select(F.col("i").alias("j"), F.lit(True).alias("has"))
    x = written(spark.range(n).select(F.col("id").alias("j")).join(ends, "j", "left").select("j", F.col("has").isNull().alias("dangling"), F.lit(1.0 / max(1, n)).alias("x")), "ranks")
    old = None
    for _ in range(steps if n else 0):
        (lost,) = _dot(x.filter("dangling"), F.col("x"))
        y = a.times(x.select("j", "x")).withColumnRenamed("i", "j")
        rank = F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("y", F.lit(0.0))
        new = x.join(y, "j", "left").select("j", "dangling", rank.alias("x"), F.abs(rank - F.col("x")).alias("moved"))
        x, old = _step(new, "ranks", old), x
        if tol and _dot(x, F.col("moved"))[0] <= tol:
            break
    return x.select("j", F.col("x").alias("rank"))


def laplacian(m: SparseMatrix, shift: float = 1.0) -> SparseMatrix:
    """The undirected pattern's Laplacian with ``shift`` on the diagonal: positive
    definite for a positive one."""
    e = adjacency(m.square().df)
    off = e.select(F.col("u").alias("i"), F.col("v").alias("j"), F.lit(-1.0).alias("v"))
    diagonal = m.df.sparkSession.range(m.nrows).select(F.col("id").alias("i")).join(e.groupBy("u").agg(F.count("*").alias("d")).withColumnRenamed("u", "i"), "i", "left")
    return SparseMatrix(off.union(diagonal.select("i", F.col("i").alias("j"), F.coalesce("d", F.lit(0)) + F.lit(shift))), m.nrows, m.nrows)


def conjugate_gradients(m: SparseMatrix, b: DataFrame, steps: int = 200, tol: float = 1e-8) -> tuple[DataFrame, int, float]:
    """(j, x) with A x = b for a symmetric positive definite A, b being (j, x);
    the steps taken, and the residual's length against b's."""
    a = stored_by_column(m)
    base = m.df.sparkSession.range(m.nrows).select(F.col("id").alias("j")).join(b.withColumnRenamed("x", "r"), "j", "left")
    r0 = F.coalesce("r", F.lit(0.0))
    state, old = written(base.select("j", F.lit(0.0).alias("x"), r0.alias("r"), r0.alias("p")), "cg"), None
    (rr,) = _dot(state, F.col("r") * F.col("r"))
    first, k = rr, 0
    while k < steps and rr > tol * tol * first and rr > 0:
        y = a.times(state.select("j", F.col("p").alias("x"))).withColumnRenamed("i", "j")
        both = written(state.join(y, "j", "left").withColumn("q", F.coalesce("y", F.lit(0.0))).drop("y"), "cg-product")
        (pq,) = _dot(both, F.col("p") * F.col("q"))
        if pq <= 0:
            raise ValueError("the matrix is not positive definite")
        alpha = rr / pq
        r = F.col("r") - F.lit(alpha) * F.col("q")
        # the new residual's length before the new direction: one aggregate more, no other pass over the matrix
        (new,) = _dot(both, r * r)
        state, old = _step(both.select("j", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), r.alias("r"), (r + F.lit(new / rr) * F.col("p")).alias("p")), "cg", old), state
        forget(both)
        rr, k = new, k + 1
    return state.select("j", "x"), k, (rr / first) ** 0.5 if first else 0.0
