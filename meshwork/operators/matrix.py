"""A sparse matrix is a DataFrame of entries (i, j, v), duplicates kept; a
vector is one of (j, x)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import ranked


class ShapeError(ValueError):
    """The operation asks for a square matrix, or an index is out of bounds."""


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    nrows: int
    ncols: int

    def square(self) -> SparseMatrix:
        if self.nrows != self.ncols:
            raise ShapeError(f"{self.nrows} x {self.ncols} is not square")
        return self

    def checked(self) -> SparseMatrix:
        """Raises if an entry lies outside the shape (a scan of the entries)."""
        out = (F.col("i") < 0) | (F.col("i") >= self.nrows) | (F.col("j") < 0) | (F.col("j") >= self.ncols)
        if not self.df.filter(out).isEmpty():
            raise ShapeError("an entry lies outside the matrix")
        return self


def symmetrize(entries: DataFrame, skew: bool = False) -> DataFrame:
    """Mirrors the entries off the diagonal; ``skew`` negates the mirrored."""
    v = -F.col("v") if skew else F.col("v")
    own, mirrored = F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v"))
    return entries.select(F.inline(F.when(F.col("i") != F.col("j"), F.array(own, mirrored)).otherwise(F.array(own))))


def coalesce_duplicates(entries: DataFrame) -> DataFrame:
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def adjacency(entries: DataFrame) -> DataFrame:
    """Edges (u, v) of the undirected pattern, without self-loops or repeats."""
    e = entries.filter("i <> j")
    return e.select(F.inline(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v"))))).distinct()


def degrees(entries: DataFrame) -> DataFrame:
    return adjacency(entries).groupBy("u").agg(F.count("*").alias("degree"))


def row_counts(entries: DataFrame) -> DataFrame:
    """Entries of each row that has any, duplicates and diagonal included."""
    return entries.groupBy("i").agg(F.count("*").alias("nnz"))


def row_pointers(m: SparseMatrix) -> DataFrame:
    """CSR row pointers: i from 0 to nrows, and the entries before row i."""
    counts = m.df.sparkSession.range(m.nrows + 1).withColumnRenamed("id", "i").join(row_counts(m.df), "i", "left")
    return ranked(counts.select("i", F.coalesce("nnz", F.lit(0)).alias("nnz")), [F.col("i")], "row_ptr", F.col("nnz")).select("i", "row_ptr")


def csr_entries(m: SparseMatrix) -> DataFrame:
    """Entries with their slot in the row, by column (equal columns by value);
    a row of any length is ranked over several partitions."""
    slots = ranked(m.df, [F.col("j"), F.col("v")], "slot", by=("i",))
    return slots.withColumn("slot", F.col("slot").cast("int"))


def row_stats(m: SparseMatrix) -> DataFrame:
    """One row: nnz, max and average entries a row, and their ratio."""
    s = row_counts(m.df).agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"), F.coalesce(F.max("nnz"), F.lit(0)).alias("max_row"))
    s = s.withColumn("avg_row", F.col("nnz") / F.lit(float(m.nrows)))
    return s.withColumn("imbalance", F.try_divide(F.col("max_row"), F.col("avg_row")))
