"""Tables of scaling, speed-up, balance and reading, from records with ``rep``
(see ``sources.results.repetitions``).  A repetition takes as long as its
slowest rank; a group's time is the median over its repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import grid_rows
from ..sources.results import repetitions

GROUP = ("matrix", "comm", "kernel", "P")
#: What the exchanges are called in the balance table.
FAMILIES = {"bcast": "1d_cyclic", "ghost_mpi": "1d_cyclic", "ghost_nccl": "1d_cyclic", "checkerboard_mpi": "2d_checkerboard", "checkerboard_nccl": "2d_checkerboard"}
#: The runs that the serial time is compared with.
BASELINES = {"speedup_bcast_cusparse_P1": ("bcast", "cusparse", 1), "speedup_ghost_cusparse_P1": ("ghost_mpi", "cusparse", 1), "speedup_ghost_cusparse_P4": ("ghost_mpi", "cusparse", 4), "speedup_ghost_nccl_cusparse_P4": ("ghost_nccl", "cusparse", 4)}
#: The methods and matrices that the figures show.
WEAK_COMMS = ("ghost_nccl", "checkerboard_nccl", "rcm_nccl", "block_nccl")
METHODS = {"cyclic": "ghost_nccl", "rcm": "rcm_nccl", "block": "block_nccl"}
STRUCTURED, UNSTRUCTURED = ("Queen_4147.mtx", "nlpkkt240.mtx"), ("webbase-2001.mtx", "com-Orkut.mtx")
THROUGHPUT = ("Queen_4147.mtx", "arabic-2005.mtx", "europe_osm.mtx", "mycielskian19.mtx", "nlpkkt240.mtx", "uk-2005.mtx")
LEFT_OUT = ("mawi_201512020330.mtx", "webbase-2001.mtx")


def times(reps: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Median, least and greatest time of each group, and its throughput."""
    rep = reps.groupBy(*keys, "rep").agg(F.max("total_avg_ms").alias("t"), F.sum("nnz_local").alias("nnz"), F.avg("effective_gflops").alias("mean_gflops"))
    rep = rep.withColumn("gflops", F.try_divide(F.col("nnz") * 2.0, F.col("t") * 1e6))
    return rep.groupBy(*keys).agg(F.median("t").alias("T_median_ms"), F.min("t").alias("T_min_ms"), F.max("t").alias("T_max_ms"), F.median("gflops").alias("aggregate_gflops"), F.median("mean_gflops").alias("mean_rank_effective_gflops"))


def _single(keys: tuple[str, ...]) -> Column:
    return F.max(F.when(F.col("P") == 1, F.col("T_median_ms"))).over(W.partitionBy(*keys))


def strong_scaling(reps: DataFrame) -> DataFrame:
    """Speed-up and efficiency against one rank; groups without that go."""
    t = times(reps).withColumn("t1", _single(("matrix", "comm", "kernel"))).filter("t1 IS NOT NULL")
    speedup = F.try_divide("t1", "T_median_ms")
    return t.select(*GROUP, "T_median_ms", "T_min_ms", "T_max_ms", speedup.alias("speedup"), (speedup / F.col("P")).alias("efficiency"), F.col("aggregate_gflops").alias("aggregate_effective_gflops"))


def weak_scaling(records: DataFrame) -> DataFrame:
    """Efficiency when the matrix grows with the ranks.  Matrices are pooled:
    repetitions follow each other in the file by exchange, kernel and P alone,
    whatever their matrix.  Takes records, not their repetitions by matrix."""
    keys = ("comm", "kernel", "P")
    t = times(repetitions(records, keys), keys).withColumn("t1", _single(("comm", "kernel"))).filter("t1 IS NOT NULL")
    return t.select(*keys, "T_median_ms", "T_min_ms", "T_max_ms", F.try_divide("t1", "T_median_ms").alias("E_weak"), "mean_rank_effective_gflops", "aggregate_gflops")


def first_rep(reps: DataFrame) -> DataFrame:
    return reps.filter("rep = 0")


def large_matrices(reps: DataFrame) -> DataFrame:
    """As strong scaling, but groups without one rank stay, and with balance."""
    t = times(reps).withColumn("t1", _single(("matrix", "comm", "kernel")))
    nnz = first_rep(reps).groupBy(*GROUP).agg(F.min("nnz_local").alias("nnz_min"), F.max("nnz_local").alias("nnz_max"), F.avg("nnz_local").alias("nnz_avg"))
    speedup = F.try_divide("t1", "T_median_ms")
    out = t.join(nnz, list(GROUP))
    return out.select(*GROUP, "T_median_ms", "T_min_ms", "T_max_ms", speedup.alias("speedup"), (speedup / F.col("P")).alias("efficiency"), F.col("aggregate_gflops").alias("aggregate_effective_gflops"), "nnz_min", "nnz_max", "nnz_avg", F.try_divide("nnz_max", "nnz_avg").alias("imbalance"))


def balance(records: DataFrame) -> DataFrame:
    """Entries of the ranks by family, matrix and P, of the first repetition in
    the files, whatever its exchange and kernel.  Takes records."""
    family = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    keys = ("family", "matrix", "P")
    rows = repetitions(records.withColumn("family", F.element_at(family, F.col("comm"))).filter("family IS NOT NULL"), keys).filter("rep = 0")
    s = rows.groupBy(*keys).agg(F.min("nnz_local").alias("nnz_min"), F.avg("nnz_local").alias("nnz_avg"), F.max("nnz_local").alias("nnz_max"), F.coalesce(F.stddev_samp("nnz_local"), F.lit(0.0)).alias("nnz_stdev"))
    return s.select("*", F.try_divide("nnz_max", "nnz_avg").alias("max_over_avg"), F.try_divide("nnz_max", "nnz_min").alias("max_over_min"))


def volume(records: DataFrame) -> DataFrame:
    """Mean bytes a rank receives, from the first repetition of each exchange,
    matrix and P (of any kernel).  Of the MPI and the NCCL runs the one that
    comes first in the files counts.  Takes records."""
    rows = repetitions(records, ("comm", "matrix", "P")).filter("rep = 0")
    cols = F.col("P") / grid_rows(F.col("P"))
    segment = F.floor(F.col("ncols_global") / cols) + (F.col("rank") % cols < F.col("ncols_global") % cols).cast("int")
    kind = F.when(F.col("comm") == "bcast", "naive").when(F.col("comm").isin("ghost_mpi", "ghost_nccl"), "ghost").when(F.col("comm").isin("checkerboard_mpi", "checkerboard_nccl"), "checkerboard")
    moved = F.when(F.col("comm") == "bcast", F.col("ncols_global")).when(kind == "ghost", F.col("n_ghost")).otherwise(segment + F.col("nrows_local"))
    per = rows.filter(kind.isNotNull()).groupBy("matrix", "P", kind.alias("kind"), "comm").agg(F.avg(moved * 4.0).alias("bytes"), F.min(F.struct(*(c for c in ("path_no", "file", "line_no") if c in rows.columns))).alias("first"))
    at = lambda k: F.min_by("bytes", F.when(F.col("kind") == k, F.col("first"))).alias(f"{k}_bytes")
    per = per.groupBy("matrix", "P").agg(at("naive"), at("ghost"), at("checkerboard"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return per.select("*", ratio("ghost_bytes", "naive_bytes").alias("ghost_over_naive"), ratio("checkerboard_bytes", "naive_bytes").alias("checkerboard_over_naive"), ratio("checkerboard_bytes", "ghost_bytes").alias("checkerboard_over_ghost"))


def baseline_speedups(serial: DataFrame, scaling: DataFrame | None) -> DataFrame:
    """Median serial time of each matrix (matrix, avg_ms), and how many times
    faster the configured runs are, by their T_median_ms in scaling summaries
    (matrix, comm, kernel, P: see ``sources.summaries``); null without one."""
    cpu = serial.groupBy("matrix").agg(F.median("avg_ms").alias("cpu_avg_ms"))
    if scaling is None:
        return cpu.select("matrix", "cpu_avg_ms", *(F.lit(None).cast("double").alias(n) for n in BASELINES))
    picks = [F.max(F.when((F.col("comm") == c) & (F.col("kernel") == k) & (F.col("P") == p), F.col("T_median_ms"))).alias(name) for name, (c, k, p) in BASELINES.items()]
    both = cpu.join(scaling.groupBy("matrix").agg(*picks), "matrix", "left")
    return both.select("matrix", "cpu_avg_ms", *(F.try_divide(F.col("cpu_avg_ms"), F.col(n)).alias(n) for n in BASELINES))


def partition_vs_cyclic(reps: DataFrame, comm: str, kernel: str = "acc", cyclic: str = "ghost_nccl") -> DataFrame:
    """A partitioner's time against dealing rows in turn; ghost fraction and
    balance of its first repetition."""
    t = times(reps).filter(F.col("kernel") == kernel)
    own = t.filter(F.col("comm") == comm).select("matrix", "P", F.col("T_median_ms").alias("T_partitioned"))
    base = t.filter(F.col("comm") == cyclic).select("matrix", "P", F.col("T_median_ms").alias("T_cyclic"))
    ghosts = first_rep(reps).filter((F.col("comm") == comm) & (F.col("kernel") == kernel)).groupBy("matrix", "P").agg(F.avg(F.when(F.col("nrows_local") > 0, F.col("n_ghost") / F.col("nrows_local"))).alias("ghost_fraction"), F.try_divide(F.max("nnz_local"), F.avg("nnz_local")).alias("nnz_max_over_avg"))
    out = own.join(base, ["matrix", "P"], "left").join(ghosts, ["matrix", "P"], "left")
    return out.select("matrix", "P", "T_partitioned", "T_cyclic", F.try_divide("T_cyclic", "T_partitioned").alias("speedup"), "ghost_fraction", "nnz_max_over_avg")


def kernel_isolation(reps: DataFrame, comms: tuple[str, ...] = ("rcm_nccl", "fennel_nccl", "block_nccl")) -> DataFrame:
    """Both kernels under each partitioner and under cyclic rows."""
    at = lambda c, k: F.max(F.when((F.col("comm") == c) & (F.col("kernel") == k), F.col("T_median_ms")))
    wide = times(reps).groupBy("matrix", "P").agg(at("ghost_nccl", "acc").alias("ca"), at("ghost_nccl", "cusparse").alias("cc"), *(at(c, k).alias(f"{c}_{k}") for c in comms for k in ("acc", "cusparse")))
    each = F.array(*(F.struct(F.lit(c.removesuffix("_nccl")).alias("prototype"), F.col(f"{c}_acc").alias("a"), F.col(f"{c}_cusparse").alias("c")) for c in comms))
    rows = wide.select("matrix", "P", "ca", "cc", F.inline(each)).filter("a IS NOT NULL OR c IS NOT NULL")
    return rows.select("prototype", "matrix", "P", F.col("ca").alias("T_cyclic_acc_ms"), F.col("cc").alias("T_cyclic_cusparse_ms"), F.col("a").alias("T_prototype_acc_ms"), F.col("c").alias("T_prototype_cusparse_ms"))


def weak_partitioned(records: DataFrame) -> DataFrame:
    """Weak scaling with the cyclic time at the same kernel and ranks."""
    t = weak_scaling(records)
    base = t.filter("comm = 'ghost_nccl'").select("kernel", "P", F.col("T_median_ms").alias("T_cyclic_ghost_nccl_median_ms"))
    own = t.filter(F.col("comm").isin("rcm_nccl", "fennel_nccl", "block_nccl"))
    return own.join(base, ["kernel", "P"], "left").select(*t.columns, "T_cyclic_ghost_nccl_median_ms", F.try_divide("T_cyclic_ghost_nccl_median_ms", "T_median_ms").alias("speedup_vs_cyclic_ghost_nccl"))


def reading(reads: DataFrame) -> DataFrame:
    """Medians of repeated read jobs; statuses that differ are listed as MIXED."""
    names = ("serial_mean_ms", "chunked_mean_ms", "serial_read_ms", "serial_distribute_ms", "chunked_io_ms", "chunked_parse_ms", "chunked_redistribute_ms")
    t = reads.groupBy("matrix", "P").agg(F.count("*").alias("n_runs"), *(F.median(n).alias(n) for n in names), F.array_sort(F.collect_set("check")).alias("checks"))
    check = F.when(F.size("checks") > 1, F.concat(F.lit("MIXED:"), F.array_join("checks", ","))).otherwise(F.col("checks")[0])
    return t.select("matrix", "P", "n_runs", *names[:2], F.try_divide("serial_mean_ms", "chunked_mean_ms").alias("speedup_chunked_over_serial"), *names[2:], check.alias("check"))


def read_check(reads: DataFrame) -> DataFrame:
    """Whether serial and chunked reading agree, by matrix and P."""
    return reads.groupBy("matrix", "P").agg(F.sum("spmv_mismatches").alias("mismatches"), F.bool_and((F.col("nnz_total_serial") == F.col("nnz_total_chunked")) & (F.col("spmv_mismatches") == 0)).alias("ok"))


# frames behind the figures


def nccl_vs_mpi(reps: DataFrame, kernel: str = "cusparse") -> DataFrame:
    """By P, the median over matrices of the time by MPI over that by NCCL."""
    at = lambda c: F.max(F.when(F.col("comm") == c, F.col("T_median_ms")))
    t = times(reps).filter(F.col("kernel") == kernel).groupBy("matrix", "P").agg(at("ghost_mpi").alias("m"), at("ghost_nccl").alias("n"))
    return t.withColumn("r", F.try_divide("m", "n")).filter("r IS NOT NULL").groupBy("P").agg(F.median("r").alias("mpi_over_nccl"), F.count("*").alias("n_matrices"))


def short_name(matrix: Column) -> Column:
    """A matrix file's name without its suffix."""
    return F.replace(matrix, F.lit(".mtx"), F.lit(""))


def weak_series(records: DataFrame, kernel: str = "cusparse") -> DataFrame:
    return weak_scaling(records).filter((F.col("kernel") == kernel) & F.col("comm").isin(*WEAK_COMMS)).select("comm", "P", "E_weak")


def structure(records: DataFrame, structured: tuple[str, ...] = STRUCTURED, unstructured: tuple[str, ...] = UNSTRUCTURED, parts: int = 4) -> DataFrame:
    """For matrices of two categories: ghost volume (over all rows of the
    ghost and the full exchange) against full broadcast, and what it gains in time."""
    rows = records.filter((F.col("P") == parts) & (F.col("kernel") == "cusparse") & F.col("matrix").isin(*structured, *unstructured))
    at = lambda c, x: F.when(F.col("comm") == c, F.col(x))
    v = rows.groupBy("matrix").agg(F.try_divide(F.avg(at("ghost_nccl", "n_ghost")), F.avg(at("bcast", "ncols_global"))).alias("ghost_over_naive"))
    t = times(repetitions(rows)).groupBy("matrix").agg(F.try_divide(F.max(at("bcast", "T_median_ms")), F.max(at("ghost_nccl", "T_median_ms"))).alias("bcast_over_ghost"))
    category = F.when(F.col("matrix").isin(*structured), "structured").otherwise("unstructured")
    return v.join(t, "matrix", "left").select(short_name(F.col("matrix")).alias("matrix"), category.alias("category"), "ghost_over_naive", "bcast_over_ghost")


def _method() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, c in METHODS.items() for x in (c, name))), F.col("comm"))


def partitioner_throughput(reps: DataFrame, matrices: tuple[str, ...] = THROUGHPUT, kernel: str = "cusparse") -> DataFrame:
    """Throughput of the methods by P, for the given matrices."""
    rows = times(reps).filter((F.col("kernel") == kernel) & F.col("comm").isin(*METHODS.values()) & F.col("matrix").isin(*matrices))
    return rows.select(short_name(F.col("matrix")).alias("matrix"), _method().alias("method"), "P", F.col("aggregate_gflops").alias("gflops"))


def partitioner_breakdown(reps: DataFrame, left_out: tuple[str, ...] = LEFT_OUT, parts: int = 4, kernel: str = "cusparse") -> DataFrame:
    """Compute and exchange time of the upper-median repetition (by time), for
    all pairs of method and matrix that any method ran; those that did not run
    at ``parts`` are labelled OOM."""
    rows = reps.filter((F.col("kernel") == kernel) & F.col("comm").isin(*METHODS.values()) & ~F.col("matrix").isin(*left_out))
    rep = rows.filter(F.col("P") == parts).groupBy("matrix", _method().alias("method"), "rep").agg(F.max("total_avg_ms").alias("t"), F.max("compute_avg_ms").alias("compute_ms"), F.max("comm_avg_ms").alias("comm_ms"))
    w = W.partitionBy("matrix", "method")
    rep = rep.withColumn("k", F.row_number().over(w.orderBy("t", "rep"))).withColumn("n", F.count("*").over(w)).filter("k = floor(n / 2) + 1")
    every = rows.select("matrix").distinct().withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    out = every.join(rep.select("matrix", "method", "compute_ms", "comm_ms"), ["matrix", "method"], "left")
    return out.select(short_name(F.col("matrix")).alias("matrix"), "method", "compute_ms", "comm_ms", F.when(F.col("compute_ms").isNull(), "OOM").alias("label"))


def matrix_order(reps: DataFrame, comm: str = "ghost_nccl", kernel: str = "cusparse") -> DataFrame:
    """Matrices by their time on one rank, those without it last by name.  The
    window has a row for each matrix."""
    t1 = F.max(F.when((F.col("comm") == comm) & (F.col("kernel") == kernel) & (F.col("P") == 1), F.col("T_median_ms")))
    t = times(reps).groupBy("matrix").agg(t1.alias("t1"))
    return t.withColumn("place", F.row_number().over(W.orderBy(F.col("t1").isNull(), "t1", "matrix")).cast("long"))
