"""Generated matrices and vectors, by hashes of the indices: any part of them
can be made anywhere, and reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix

#: rows a part, entries a row, seed
DENSE, LOW_DEGREE = (75_000, 20, 42), (750_000, 2, 142)


def uniform(spark: SparkSession, parts: int, rows: int, per_row: int, seed: int) -> SparseMatrix:
    """Columns uniform with replacement, values uniform in (-1, 1) to six
    decimals; n = rows x parts, and the seed grows with the parts."""
    n = rows * parts
    e = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("k"))
    u = F.pmod(F.xxhash64(F.lit(seed + parts), F.lit("v"), "i", "k"), F.lit(1_999_999)) - 999_999
    return SparseMatrix(e.select("i", F.pmod(F.xxhash64(F.lit(seed + parts), F.lit("j"), "i", "k"), F.lit(n)).alias("j"), (u / 1e6).alias("v")), n, n)


def vector(indices: DataFrame, name: str = "j") -> DataFrame:
    """x_j = (7919 j mod 1000) - 500 for the given indices."""
    return indices.select(F.col(name).alias("j"), (F.pmod(F.col(name) * 7919, F.lit(1000)) - 500).cast("double").alias("x"))
