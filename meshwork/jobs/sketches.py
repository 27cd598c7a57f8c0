"""Summaries of runs with mergeable sketches: quantiles of times and distinct
matrices, stored once for each group and merged over grouping sets without going
back to the records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("matrix", "comm", "kernel", "P")
#: The sketch's size: ranks are off by about 1.3 in 100 or less.
K = 200


def summarised(records: DataFrame, value: str = "total_avg_ms", by: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """For each group: n, least, greatest and sum of the values, and the sketches
    ``quantiles`` (of the values) and ``distinct`` (of the matrices)."""
    v = F.col(value)
    return records.filter(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v.cast("double"), K).alias("quantiles"), F.hll_sketch_agg("matrix").alias("distinct"))


def merged(tables: list[DataFrame], by: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Summary tables of separate logs as one."""
    return _merge(reduce(DataFrame.unionByName, tables).groupBy(*by))


def _merge(groups) -> DataFrame:
    return groups.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles", K).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def cube(summaries: DataFrame, by: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """All grouping sets of a summary table: the dimensions (null: all of them),
    ``grouping`` (a bit for each that is), n, least, greatest, average, median,
    the 95th percentile and the number of matrices, the last three by sketches."""
    s = summaries.cube(*by).agg(F.grouping_id().cast("int").alias("grouping"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles", K).alias("q"), F.hll_union_agg("distinct").alias("d"))
    at = lambda p: F.kll_sketch_get_quantile_double("q", F.lit(p))
    return s.select(*by, "grouping", "n", "least", "greatest", (F.col("total") / F.col("n")).alias("average"), at(0.5).alias("median"), at(0.95).alias("p95"), F.hll_sketch_estimate("d").alias("n_matrices"))
