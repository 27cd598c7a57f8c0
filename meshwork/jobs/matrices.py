"""The matrices and vectors that queries make of the driver's tables: OP (orders x
parts, l_quantity), PP (parts that follow each other in an order) and x."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from ..sources import generate

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_parts(spark: SparkSession, sf_dir: str) -> int:
    return size(spark, sf_dir, "part", "p_partkey")


def size(spark: SparkSession, sf_dir: str, table: str, key: str) -> int:
    """One more than the greatest key; 0 for an empty table."""
    return read(spark, sf_dir, table).agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0]


def op_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    df = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return SparseMatrix(df, size(spark, sf_dir, "orders", "o_orderkey"), n_parts(spark, sf_dir))


def pp_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    df = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.lead("l_partkey").over(order).alias("j"), F.col("l_quantity").alias("v")).filter("j IS NOT NULL")
    n = n_parts(spark, sf_dir)
    return SparseMatrix(df, n, n)


def x_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.vector(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


PP_SQL = "pp AS (SELECT i, j, v FROM (SELECT l_partkey AS i, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS j, l_quantity AS v FROM lineitem) WHERE j IS NOT NULL), n AS (SELECT max(p_partkey) + 1 AS n FROM part), x AS (SELECT p_partkey AS j, CAST((p_partkey * 7919) % 1000 - 500 AS DOUBLE) AS x FROM part)"
