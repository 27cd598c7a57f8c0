"""Summary tables as CSV files with a header, and tables merged from several."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIMES = "T_median_ms double, T_min_ms double, T_max_ms double"
_STRONG = f"matrix string, comm string, kernel string, P int, {_TIMES}, speedup double, efficiency double, aggregate_effective_gflops double"
_WEAK = f"comm string, kernel string, P int, {_TIMES}, E_weak double, mean_rank_effective_gflops double, aggregate_gflops double"
_VERSUS = "matrix string, P int, T_partitioned double, T_cyclic double, speedup double, ghost_fraction double, nnz_max_over_avg double"
#: The summaries' columns.
SCHEMAS = {
    "strong_scaling": _STRONG,
    "weak_scaling": _WEAK,
    "large_matrices": f"{_STRONG}, nnz_min long, nnz_max long, nnz_avg double, imbalance double",
    "comm_volume": "matrix string, P int, naive_bytes double, ghost_bytes double, checkerboard_bytes double, ghost_over_naive double, checkerboard_over_naive double, checkerboard_over_ghost double",
    "load_balance": "family string, matrix string, P int, nnz_min long, nnz_avg double, nnz_max long, nnz_stdev double, max_over_avg double, max_over_min double",
    "baseline": "matrix string, cpu_avg_ms double, speedup_bcast_cusparse_P1 double, speedup_ghost_cusparse_P1 double, speedup_ghost_cusparse_P4 double, speedup_ghost_nccl_cusparse_P4 double",
    "partition_vs_cyclic": _VERSUS,
    "kernel_isolation": "prototype string, matrix string, P int, T_cyclic_acc_ms double, T_cyclic_cusparse_ms double, T_prototype_acc_ms double, T_prototype_cusparse_ms double",
    "weak_partitioned": f"{_WEAK}, T_cyclic_ghost_nccl_median_ms double, speedup_vs_cyclic_ghost_nccl double",
    "mtx_read": "matrix string, P int, n_runs long, serial_mean_ms double, chunked_mean_ms double, speedup_chunked_over_serial double, serial_read_ms double, serial_distribute_ms double, chunked_io_ms double, chunked_parse_ms double, chunked_redistribute_ms double, check string",
}


def write(summary: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """One CSV file with a header, in the order of ``keys``.  A summary has a
    row for each group of runs, so that one file holds it; nulls are empty."""
    summary.orderBy(*keys).coalesce(1).write.option("header", "true").option("emptyValue", "").csv(path)


def read(spark: SparkSession, path: str | list[str], name: str, required: bool = True) -> DataFrame | None:
    """A summary of CSV files, its columns found by their names in the header;
    columns that the file lacks, empty fields and ``nan`` are null.  None if
    there is no such file and it is not ``required``."""
    try:
        raw = spark.read.option("header", "true").csv(path)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    cols = []
    for c, kind in (x.strip().split(" ") for x in SCHEMAS[name].split(",")):
        value = F.col(c).try_cast(kind) if c in raw.columns else F.lit(None).cast(kind)
        cols.append((F.when(~F.isnan(value), value) if kind == "double" else value).alias(c))
    return raw.select(*cols)


def merged(tables: list[DataFrame | None], keys: tuple[str, ...]) -> DataFrame | None:
    """The union of tables, those that are None left out; of rows with equal
    keys the one of the latest table counts (within a table, the greatest)."""
    given = [t for t in tables if t is not None]
    if not given:
        return None
    names = [c for c in given[0].columns if all(c in t.columns for t in given)]
    both = reduce(DataFrame.unionByName, [t.select(*names, F.lit(k).alias("__source")) for k, t in enumerate(given)])
    rest = [c for c in names if c not in keys]
    last = F.max(F.struct("__source", *rest)).alias("__last")
    return both.groupBy(*keys).agg(last).select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*names)
