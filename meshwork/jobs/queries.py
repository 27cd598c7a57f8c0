"""The registered queries: every operator applied to the driver's tables, with
the SQL that gives the same rows.

Matrices: OP (orders x parts, l_quantity) and PP (parts that follow each other
in an order).  Records of benchmark runs are derived from ``events``: each event
is a repetition of P ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.tables import fresh_path
from ..operators import matrix, partition, spmv
from ..operators.matrix import SparseMatrix
from ..sources import generate, mtx, results, summaries
from . import joins, linear, scaling
from .matrices import PP_SQL, Query, op_matrix, pp_matrix, x_vector
from .matrices import n_parts as _n_parts
from .matrices import read as _read

P = 4


SPMV_SQL = f"WITH {PP_SQL} SELECT pp.i AS i, sum(pp.v * x.x) AS y FROM pp JOIN x ON pp.j = x.j GROUP BY pp.i"


def _product(**how) -> Query:
    return lambda spark, sf: spmv.spmv(pp_matrix(spark, sf), x_vector(spark, sf), parts=P, **how)


def _mapped(make: Callable[[SparseMatrix], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        m = pp_matrix(spark, sf)
        return spmv.spmv(m, x_vector(spark, sf), exchange="ghost", parts=P, assignment=make(m))

    return run


def _split(spark: SparkSession, sf: str) -> DataFrame:
    m = pp_matrix(spark, sf)
    rows = spark.range(m.nrows).withColumnRenamed("id", "g").join(matrix.row_counts(m.df).withColumnRenamed("i", "g"), "g", "left").select("g", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    _, starts = partition.balanced_split(rows, m.nrows, P, [F.col("g")])
    cuts = list(zip(range(P), starts[:-1], starts[1:], strict=True))
    return spark.createDataFrame(cuts, "p int, start long, end long").select("p", "start", F.col("end").alias("stop"))


def _rcm_blocks(spark: SparkSession, sf: str) -> DataFrame:
    m = pp_matrix(spark, sf)
    return partition.assign_rcm(m, P)[0]


def _other(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A product, and one of which every seventh row is off."""
    y = _product()(spark, sf)
    return y, y.select("i", F.when(F.col("i") % 7 == 0, F.col("y") * 1.5 + 1).otherwise(F.col("y") + 0.001).alias("y"))


# records from events

COMMS = ("bcast", "ghost_mpi", "ghost_nccl", "checkerboard_mpi", "checkerboard_nccl", "rcm_nccl", "fennel_nccl", "block_nccl")
KERNELS = ("acc", "cusparse")


def _pick(names: tuple[str, ...], k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_E, _R = "event_id", "rank"
_RANKED = "SELECT event_id, CAST(event_id % 4 + 1 AS INT) AS \"P\", CAST(r AS INT) AS rank FROM events, (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ranks WHERE r <= event_id % 4"
_FIELDS = f"""event_id, "P", rank, {_pick(COMMS, "(event_id // 4) % 8")} AS comm, {_pick(KERNELS, "(event_id // 32) % 2")} AS kernel,
  concat('m', CAST((event_id // 64) % 5 AS VARCHAR), '.mtx') AS matrix,
  CAST(400 + rank AS BIGINT) AS nrows_local, CAST(1600 AS BIGINT) AS ncols_global, CAST(1000 + (event_id * 13 + rank * 17) % 500 AS BIGINT) AS nnz_local, CAST((event_id * 5 + rank * 3) % 300 AS BIGINT) AS n_ghost,
  CAST(1 + (event_id * 37 + rank * 101) % 97 AS DOUBLE) AS compute_avg_ms, CAST(1 + (event_id * 11 + rank * 7) % 53 AS DOUBLE) AS comm_avg_ms,
  CAST(2 + (event_id * 37 + rank * 101) % 97 + (event_id * 11 + rank * 7) % 53 AS DOUBLE) AS total_avg_ms,
  CAST(1 + (event_id * 3 + rank) % 64 AS DOUBLE) / 16 AS effective_gflops"""
RECORDS_SQL = f"""ranked AS ({_RANKED}), records AS (SELECT {_FIELDS} FROM ranked),
reps AS (SELECT *, dense_rank() OVER (PARTITION BY matrix, comm, kernel, "P" ORDER BY event_id) - 1 AS rep FROM records)"""
RECORD_KEYS = ("comm", "kernel", "matrix", "P", "rank", "nrows_local", "ncols_global", "nnz_local", "n_ghost", "compute_avg_ms", "comm_avg_ms", "total_avg_ms", "effective_gflops")


def _matrix(k) -> Column:
    return F.concat(F.lit("m"), k.cast("string"), F.lit(".mtx"))


def _event_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the events, dealt to as many tasks as run at once: each makes
    several log lines, of which a small file holds very many."""
    return _read(spark, sf, "events").select("event_id").repartition(spark.sparkContext.defaultParallelism)


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_ids(spark, sf).select("event_id", (F.col("event_id") % 4 + 1).cast("int").alias("P"))
    r = e.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("P") - 1)))
    k = lambda names, q: F.element_at(F.array(*map(F.lit, names)), (q + 1).cast("int"))
    eid, rank = F.col("event_id"), F.col("rank")
    div = lambda n: F.floor(eid / n)
    compute, comm = 1 + (eid * 37 + rank * 101) % 97, 1 + (eid * 11 + rank * 7) % 53
    return r.select(
        "event_id", "P", "rank", k(COMMS, div(4) % 8).alias("comm"), k(KERNELS, div(32) % 2).alias("kernel"), _matrix(div(64) % 5).alias("matrix"),
        (400 + rank).cast("long").alias("nrows_local"), F.lit(1600).cast("long").alias("ncols_global"), (1000 + (eid * 13 + rank * 17) % 500).alias("nnz_local"), ((eid * 5 + rank * 3) % 300).alias("n_ghost"),
        compute.cast("double").alias("compute_avg_ms"), comm.cast("double").alias("comm_avg_ms"), (compute + comm).cast("double").alias("total_avg_ms"), ((1 + (eid * 3 + rank) % 64) / 16.0).alias("effective_gflops"),
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The records as log lines of one file, with noise between."""
    rec = records(spark, sf)
    line = F.concat_ws(" ", F.lit("RESULT"), *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in RECORD_KEYS))
    lines = rec.select(F.lit("events").alias("file"), (F.col("event_id") * 8 + F.col("rank")).alias("line_no"), line.alias("line"))
    noise = _event_ids(spark, sf).select(F.lit("events").alias("file"), (F.col("event_id") * 8 + 7).alias("line_no"), F.lit("=== next ===").alias("line"))
    return lines.unionByName(noise)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the log lines, with the columns that the summaries need."""
    return results.parse(log_lines(spark, sf)).select("file", "line_no", *RECORD_KEYS)


def reps(spark: SparkSession, sf: str) -> DataFrame:
    return results.repetitions(parsed(spark, sf))


def _on(rows: Callable[[SparkSession, str], DataFrame]) -> Callable[..., Query]:
    def make(f: Callable[[DataFrame], DataFrame], *rounded: str) -> Query:
        return lambda spark, sf: f(rows(spark, sf)).withColumns({c: F.round(c, 9) for c in rounded})

    return make


_on_reps = _on(reps)
_on_records = _on(parsed)


def log_files(spark: SparkSession, sf: str) -> str:
    """The log lines as text files of a folder, in the files' and lines' order."""
    path = fresh_path(spark, "logs")
    lines = log_lines(spark, sf).repartitionByRange(8, "line_no").sortWithinPartitions("line_no")
    lines.select("line").write.text(path)
    return path


def _file_repetitions(spark: SparkSession, sf: str) -> DataFrame:
    """Repetitions of records that are read from log files."""
    rows = results.repetitions(results.parse(results.numbered_lines(spark, log_files(spark, sf), "RESULT ")))
    return rows.select("matrix", "comm", "kernel", "P", "rank", "nnz_local", "total_avg_ms", "rep")


def _mtx_file(spark: SparkSession, sf: str) -> DataFrame:
    """PP written as a Matrix Market file and read again."""
    path = fresh_path(spark, "matrix")
    mtx.write(pp_matrix(spark, sf), path)
    m = mtx.read(spark, path)
    return m.df.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.lit(m.nrows).cast("long").alias("nrows"))


STRONG_KEYS = ("matrix", "comm", "kernel", "P")


def _summary_file(spark: SparkSession, df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    path = fresh_path(spark, "summary")
    summaries.write(df, path, keys)
    return summaries.read(spark, path, name)


def _strong_file(spark: SparkSession, sf: str) -> DataFrame:
    """The strong-scaling summary written as CSV and read again."""
    return _summary_file(spark, QUERIES["strong_scaling"](spark, sf), "strong_scaling", STRONG_KEYS)


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Serial speed-ups by the times of two summary files, of which the later
    one has other times for the matrices m0 and m1; a third does not exist."""
    strong = _strong_file(spark, sf)
    large = strong.filter(F.col("matrix").isin("m0.mtx", "m1.mtx")).withColumn("T_median_ms", F.col("T_median_ms") * 2)
    large = large.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("nnz_min", "long"), ("nnz_max", "long"), ("nnz_avg", "double"), ("imbalance", "double"))))
    missing = summaries.read(spark, fresh_path(spark, "absent"), "strong_scaling", required=False)
    times = summaries.merged([strong, _summary_file(spark, large, "large_matrices", STRONG_KEYS), missing], STRONG_KEYS)
    return scaling.baseline_speedups(_serial(spark, sf), times).withColumns({n: F.round(n, 9) for n in scaling.BASELINES})


TIMES_SQL = f"""{RECORDS_SQL}, per_rep AS (SELECT matrix, comm, kernel, "P", rep, max(total_avg_ms) AS t, sum(nnz_local) AS nnz, avg(effective_gflops) AS mg FROM reps GROUP BY ALL),
times AS (SELECT matrix, comm, kernel, "P", median(t) AS tm, min(t) AS tl, max(t) AS th, median(nnz * 2.0 / (t * 1e6)) AS gf, median(mg) AS mg FROM per_rep GROUP BY ALL),
based AS (SELECT *, max(CASE WHEN "P" = 1 THEN tm END) OVER (PARTITION BY matrix, comm, kernel) AS t1 FROM times)"""
WEAK_SQL = f"""{RECORDS_SQL}, weak_reps AS (SELECT comm, kernel, "P", total_avg_ms, nnz_local, effective_gflops, (row_number() OVER (PARTITION BY comm, kernel, "P" ORDER BY event_id, rank) - 1) // "P" AS rep FROM records),
per_rep AS (SELECT comm, kernel, "P", rep, max(total_avg_ms) AS t, sum(nnz_local) AS nnz, avg(effective_gflops) AS mg FROM weak_reps GROUP BY ALL),
times AS (SELECT comm, kernel, "P", median(t) AS tm, min(t) AS tl, max(t) AS th, median(nnz * 2.0 / (t * 1e6)) AS gf, median(mg) AS mg FROM per_rep GROUP BY ALL),
weak AS (SELECT comm, kernel, "P", tm AS "T_median_ms", tl AS "T_min_ms", th AS "T_max_ms", round(t1 / tm, 9) AS "E_weak", round(mg, 9) AS mean_rank_effective_gflops, round(gf, 9) AS aggregate_gflops FROM (SELECT *, max(CASE WHEN "P" = 1 THEN tm END) OVER (PARTITION BY comm, kernel) AS t1 FROM times) WHERE t1 IS NOT NULL)"""
VOLUME_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY comm, matrix, "P" ORDER BY event_id, rank) AS k FROM records), opening AS (SELECT *, CASE WHEN "P" = 4 THEN 2 ELSE "P" END AS pc FROM placed WHERE k <= "P"),
moved AS (SELECT matrix, "P", comm, min(event_id) AS began, avg(ncols_global * 4.0) AS naive, avg(n_ghost * 4.0) AS ghost, avg((ncols_global // pc + (CASE WHEN rank % pc < ncols_global % pc THEN 1 ELSE 0 END) + nrows_local) * 4.0) AS board FROM opening GROUP BY ALL),
vol AS (SELECT matrix, "P", max(naive) FILTER (WHERE comm = 'bcast') AS naive_bytes, arg_min(ghost, began) FILTER (WHERE comm IN ('ghost_mpi', 'ghost_nccl')) AS ghost_bytes, arg_min(board, began) FILTER (WHERE comm IN ('checkerboard_mpi', 'checkerboard_nccl')) AS checkerboard_bytes FROM moved WHERE comm IN ('bcast', 'ghost_mpi', 'ghost_nccl', 'checkerboard_mpi', 'checkerboard_nccl') GROUP BY ALL)"""


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Read-benchmark lines from events: three jobs for each matrix and P, some old ones."""
    e = F.col("event_id")
    c = lambda f: f.cast("double").cast("string")
    fields = [("matrix", F.concat(F.lit("m"), (e % 7).cast("string"))), ("P", (F.floor(e / 7) % 4 + 1).cast("string")), ("reps", F.lit("3"))]
    fields += [(n, c(1 + (e * (3 + k) + k) % (50 + k))) for k, n in enumerate(results.READ_DOUBLES) if n != "chunked_mean_ms"]
    fields += [("nnz_total_serial", (1000 + e % 3).cast("string")), ("nnz_total_chunked", F.lit("1000")), ("spmv_mismatches", F.lit("0")), ("check", F.when(e % 3 == 0, "OK!").otherwise("MISMATCH!"))]
    new = F.when(e % 11 == 0, F.concat(F.lit("mpiio_ms="), c(e % 9))).otherwise(F.concat(F.lit("chunked_mean_ms="), c(1 + e % 40)))
    line = F.concat_ws(" ", F.lit("RESULT_CSV_READ"), *(F.concat(F.lit(f"{k}="), v) for k, v in fields), new)
    return _event_ids(spark, sf).select(F.lit("events").alias("file"), e.alias("line_no"), line.alias("line"))


READS_SQL = "reads AS (SELECT event_id, concat('m', CAST(event_id % 7 AS VARCHAR)) AS matrix, CAST((event_id // 7) % 4 + 1 AS INT) AS \"P\", " + ", ".join(f"CAST(1 + (event_id * {3 + k} + {k}) % {50 + k} AS DOUBLE) AS {n}" for k, n in enumerate(results.READ_DOUBLES) if n != "chunked_mean_ms") + ", CAST(1 + event_id % 40 AS DOUBLE) AS chunked_mean_ms, 1000 + event_id % 3 AS nnz_s, CASE WHEN event_id % 3 = 0 THEN 'OK!' ELSE 'MISMATCH!' END AS chk FROM events WHERE event_id % 11 <> 0)"


def _serial(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(_matrix(F.col("event_id") % 5).alias("matrix"), (500 + F.col("event_id") % 101).cast("double").alias("avg_ms"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    """Average, least, greatest and population variance of each group's samples."""
    r = records(spark, sf).groupBy("comm", "kernel")
    return r.agg(F.avg("total_avg_ms").alias("avg_ms"), F.min("total_avg_ms").alias("min_ms"), F.max("total_avg_ms").alias("max_ms"), F.round(F.var_pop("total_avg_ms"), 6).alias("variance_ms")).withColumn("avg_ms", F.round("avg_ms", 9))


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    moved = scalars.bytes_moved(F.col("nnz_local"), F.col("nrows_local"), F.col("ncols_global"), F.ceil(F.col("nnz_local") / spmv.TILE))
    gbs = scalars.bandwidth(moved, F.col("compute_avg_ms"))
    return r.select("event_id", "rank", moved.cast("long").alias("bytes"), F.round(scalars.gflops(F.col("nnz_local"), F.col("compute_avg_ms")), 12).alias("gflops"), F.round(gbs, 12).alias("gbs"), F.round(scalars.percent_of_peak(gbs), 12).alias("pct_peak"))


def _mtx_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of OP written as Matrix Market lines and parsed again, with
    comments and blank lines between."""
    li = _read(spark, sf, "lineitem")
    m = SparseMatrix(li.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), 1, 1)
    noise = li.filter("l_linenumber = 1").select(F.explode(F.array(F.lit("% comment"), F.lit("  "))).alias("value"))
    return mtx.entries_of(mtx.entry_lines(m).unionByName(noise)).groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


def _embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.round(F.col("v").cast("double") * 1024).alias("v"))
    x = spark.range(64).select(F.col("id").alias("j"), (F.col("id") - 32).cast("double").alias("x"))
    return spmv.spmv(SparseMatrix(e, 0, 64), x, exchange="broadcast")


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """Both generated families with a row for each part key: entries a row,
    whether they lie inside, and the vectors' value at the row."""
    n, out = _n_parts(spark, sf), None
    for family, (_, per_row, seed) in (("dense", generate.DENSE), ("low_degree", generate.LOW_DEGREE)):
        m = generate.uniform(spark, 1, n, per_row, seed)
        rows = m.df.groupBy("i").agg(F.count("*").alias("nnz"), F.bool_and((F.col("j") >= 0) & (F.col("j") < m.ncols) & (F.abs("v") < 1)).alias("inside"))
        rows = rows.join(x_vector(spark, sf).withColumnRenamed("j", "i"), "i").select(F.lit(family).alias("family"), "i", "nnz", "inside", "x")
        out = rows if out is None else out.unionByName(rows)
    return out


def _ghost_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Ghosts a row of PP under dealt rows, and what uniform columns would give."""
    m = pp_matrix(spark, sf)
    need = partition.ghost_need(m.df, P).groupBy("p").agg(F.count("*").alias("n_ghost"))
    rows = F.floor(F.lit(m.nrows) / P) + (F.col("p") < m.nrows % P).cast("int")
    expected = scalars.expected_ghost_fraction(m.df.count() / m.nrows, F.lit(P))
    return need.select("p", "n_ghost", F.round(F.col("n_ghost") / rows, 9).alias("ghost_fraction"), F.round(expected, 9).alias("expected"))


def _pp(f: Callable[[SparseMatrix], DataFrame]) -> Query:
    return lambda spark, sf: f(pp_matrix(spark, sf))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


RATIOS = ("ghost_over_naive", "checkerboard_over_naive", "checkerboard_over_ghost")

QUERIES: dict[str, Query] = {
    "spmv_broadcast_rect": lambda spark, sf: spmv.spmv(op_matrix(spark, sf), x_vector(spark, sf), exchange="broadcast"),
    "spmv_plain": _product(),
    "spmv_broadcast": _product(exchange="broadcast"),
    "spmv_ghost": _product(exchange="ghost"),
    "spmv_checkerboard": _product(exchange="checkerboard"),
    "spmv_block_mapped": _mapped(lambda m: partition.assign_block(m.df.sparkSession, m.nrows, P)),
    "spmv_rcm_mapped": _mapped(lambda m: partition.assign_rcm(m, P)[0]),
    "spmv_greedy_mapped": _mapped(lambda m: partition.assign_greedy(m, P)),
    "spmv_line": _product(kernel="line"),
    "spmv_flat": _product(kernel="flat"),
    "spmv_dense_output": lambda spark, sf: spmv.dense(_product()(spark, sf), _n_parts(spark, sf)),
    "coo_to_csr_row_ptr": _pp(matrix.row_pointers),
    "csr_entries": _pp(matrix.csr_entries),
    "symmetrize_general": _pp(lambda m: matrix.symmetrize(m.df).groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))),
    "symmetrize_skew": _pp(lambda m: matrix.symmetrize(m.df, skew=True).groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))),
    "coalesce_duplicates": _pp(lambda m: matrix.coalesce_duplicates(m.df)),
    "adjacency_degree": _pp(lambda m: matrix.degrees(m.df)),
    "row_nnz": _pp(lambda m: matrix.row_counts(m.df)),
    "row_nnz_stats": _pp(lambda m: _rounded(matrix.row_stats(m), "avg_row", "imbalance")),
    "kernel_choice": _pp(lambda m: _rounded(spmv.kernel_choice(m), "avg_row", "imbalance")),
    "cyclic_shards": _pp(lambda m: partition.shards(m.df, P)),
    "block_shards": _pp(lambda m: partition.mapped_shards(m.df, partition.assign_block(m.df.sparkSession, m.nrows, P))),
    "checkerboard_shards": _pp(lambda m: partition.checkerboard(m.df, P)),
    "ghost_sets": _pp(lambda m: partition.ghost_need(m.df, P)),
    "ghost_need_counts": _pp(lambda m: partition.ghost_counts(m.df, P)),
    "ghost_requests": _pp(lambda m: partition.ghost_requests(m.df, P)),
    "ghost_compact_columns": _pp(lambda m: partition.compact_columns(m, P)),
    "ghost_fraction": _ghost_fraction,
    "comm_volume": _pp(lambda m: _rounded(partition.comm_volume(m, (1, 2, 3, 4)), *RATIOS)),
    "load_balance": _pp(lambda m: _rounded(partition.load_balance(m, (1, 2, 4)), "nnz_stdev", "max_over_avg", "max_over_min")),
    "nnz_balanced_split": _split,
    "rcm_order": _pp(partition.rcm_order),
    "rcm_blocks": _rcm_blocks,
    "greedy_assign": _pp(lambda m: partition.assign_greedy(m, P)),
    "flat_breakpoints": _pp(spmv.breakpoints),
    "verify_almost_equal": lambda spark, sf: spmv.compare(*_other(spark, sf)).groupBy("ok").agg(F.count("*").alias("n")),
    "first_mismatches": lambda spark, sf: spmv.mismatches(*_other(spark, sf)),
    "mtx_entries": _mtx_parse,
    "generated_rows": _generated,
    "embedding_spmv": _embedding,
    "result_records": lambda spark, sf: results.parse(log_lines(spark, sf)).select("line_no", *RECORD_KEYS),
    "result_lines": lambda spark, sf: results.lines_of(records(spark, sf), ("comm", "kernel", "matrix", "P", "rank", "nnz_local")),
    "repetitions": lambda spark, sf: reps(spark, sf).select("line_no", "matrix", "comm", "kernel", "P", "rank", "rep"),
    "bench_stats": _stats,
    "run_figures": _figures,
    "strong_scaling": _on_reps(scaling.strong_scaling, "speedup", "efficiency", "aggregate_effective_gflops"),
    "weak_scaling": _on_records(scaling.weak_scaling, "E_weak", "mean_rank_effective_gflops", "aggregate_gflops"),
    "large_matrices": _on_reps(scaling.large_matrices, "speedup", "efficiency", "aggregate_effective_gflops", "nnz_avg", "imbalance"),
    "run_balance": _on_records(scaling.balance, "nnz_avg", "nnz_stdev", "max_over_avg", "max_over_min"),
    "run_volume": _on_records(scaling.volume, "naive_bytes", "ghost_bytes", "checkerboard_bytes", *RATIOS),
    "baseline_speedup": _baseline,
    "summary_csv": _strong_file,
    "result_files": _file_repetitions,
    "mtx_file": _mtx_file,
    "kernel_isolation": _on_reps(scaling.kernel_isolation),
    "weak_partitioned": _on_records(scaling.weak_partitioned, "E_weak", "mean_rank_effective_gflops", "aggregate_gflops", "speedup_vs_cyclic_ghost_nccl"),
    "mtx_read_summary": lambda spark, sf: scaling.reading(results.parse_reads(reads(spark, sf))).withColumn("speedup_chunked_over_serial", F.round("speedup_chunked_over_serial", 9)),
    "mtx_read_check": lambda spark, sf: scaling.read_check(results.parse_reads(reads(spark, sf))),
    "mtx_read_skipped": lambda spark, sf: results.old_reads(reads(spark, sf)),
    "nccl_vs_mpi": _on_reps(scaling.nccl_vs_mpi, "mpi_over_nccl"),
    "weak_efficiency_series": _on_records(scaling.weak_series, "E_weak"),
    "structured_vs_unstructured": _on_records(lambda r: scaling.structure(r, ("m0.mtx", "m2.mtx"), ("m3.mtx",)), "ghost_over_naive", "bcast_over_ghost"),
    "partitioner_throughput": _on_reps(lambda r: scaling.partitioner_throughput(r, ("m0.mtx", "m1.mtx", "m3.mtx")), "gflops"),
    "partitioner_breakdown": _on_reps(lambda r: scaling.partitioner_breakdown(r, ("m4.mtx",))),
    "matrix_order": _on_reps(scaling.matrix_order),
}
for _comm in ("rcm", "fennel", "block"):
    QUERIES[f"{_comm}_vs_cyclic"] = _on_reps(lambda r, c=_comm: scaling.partition_vs_cyclic(r, f"{c}_nccl"), "speedup", "ghost_fraction", "nnz_max_over_avg")


def _sym(skew: bool) -> str:
    return f"WITH {PP_SQL} SELECT i, j, sum(v) AS v, count(*) AS n FROM (SELECT i, j, v FROM pp UNION ALL SELECT j, i, {'-v' if skew else 'v'} FROM pp WHERE i <> j) GROUP BY i, j"


_NEED = "need AS (SELECT DISTINCT CAST(i % 4 AS INT) AS p, CAST(j % 4 AS INT) AS owner, j // 4 AS lidx FROM pp WHERE i % 4 <> j % 4), slots AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY owner, lidx) - 1 AS slot FROM need)"
_ROWS = "rows AS (SELECT i, count(*) AS nnz FROM pp GROUP BY i), stats AS (SELECT sum(nnz) AS nnz, max(nnz) AS max_row, CAST(sum(nnz) AS DOUBLE) / (SELECT n FROM n) AS avg_row FROM rows)"
_EDGES = "edges AS (SELECT i AS u, j AS v FROM pp WHERE i <> j UNION SELECT j, i FROM pp WHERE i <> j)"


def _volume(p: int, rows: int, cols: int) -> str:
    """Bytes of every rank by the rule of the records' volumes, then their mean."""
    local = lambda dim, k: f"(n // {dim} + CASE WHEN {k} < n % {dim} THEN 1 ELSE 0 END)"
    ranks = " UNION ALL ".join(f"SELECT n * 4.0 AS naive, (SELECT count(DISTINCT j) FROM pp WHERE i % {p} = {r} AND j % {p} <> {r}) * 4.0 AS ghost, ({local(cols, r % cols)} + {local(rows, r // cols)}) * 4.0 AS board FROM n" for r in range(p))
    return f"SELECT {p} AS \"P\", CAST(avg(naive) AS DOUBLE) AS a, CAST(avg(ghost) AS DOUBLE) AS b, CAST(avg(board) AS DOUBLE) AS c FROM ({ranks})"


def _balance(p: int) -> str:
    rows, cols = scalars.grid(p)
    parts = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(p))
    one = f"SELECT '1d_cyclic' AS family, k, (SELECT count(*) FROM pp WHERE i % {p} = k) AS c FROM ({parts})"
    two = f"SELECT '2d_checkerboard' AS family, k, (SELECT count(*) FROM pp WHERE (i % {rows}) * {cols} + j % {cols} = k) AS c FROM ({parts})"
    return f"SELECT family, {p} AS \"P\", min(c) AS nnz_min, avg(c) AS nnz_avg, max(c) AS nnz_max, round(coalesce(stddev_samp(c), 0.0), 6) AS nnz_stdev, round(max(c) / avg(c), 6) AS max_over_avg, round(max(c) / CAST(min(c) AS DOUBLE), 6) AS max_over_min FROM ({one} UNION ALL {two}) GROUP BY family"


def _versus(comm: str) -> str:
    return f"""WITH {TIMES_SQL} SELECT a.matrix, a."P", a.tm AS "T_partitioned", b.tm AS "T_cyclic", round(b.tm / a.tm, 9) AS speedup, round(g.f, 9) AS ghost_fraction, round(g.r, 9) AS nnz_max_over_avg
FROM (SELECT * FROM times WHERE kernel = 'acc' AND comm = '{comm}_nccl') a LEFT JOIN (SELECT * FROM times WHERE kernel = 'acc' AND comm = 'ghost_nccl') b ON a.matrix = b.matrix AND a."P" = b."P"
LEFT JOIN (SELECT matrix, "P", avg(CAST(n_ghost AS DOUBLE) / nrows_local) AS f, max(nnz_local) / avg(nnz_local) AS r FROM reps WHERE rep = 0 AND kernel = 'acc' AND comm = '{comm}_nccl' GROUP BY matrix, "P") g ON a.matrix = g.matrix AND a."P" = g."P" """


def _at(comm: str, kernel: str) -> str:
    return f"max(CASE WHEN comm = '{comm}' AND kernel = '{kernel}' THEN tm END)"


SQL: dict[str, str] = {
    "spmv_broadcast_rect": f"WITH {PP_SQL} SELECT l_orderkey AS i, sum(l_quantity * x.x) AS y FROM lineitem JOIN x ON l_partkey = x.j GROUP BY l_orderkey",
    **dict.fromkeys(("spmv_plain", "spmv_broadcast", "spmv_ghost", "spmv_checkerboard", "spmv_block_mapped", "spmv_rcm_mapped", "spmv_greedy_mapped", "spmv_line", "spmv_flat"), SPMV_SQL),
    "spmv_dense_output": f"WITH {PP_SQL}, y AS (SELECT pp.i, sum(pp.v * x.x) AS y FROM pp JOIN x ON pp.j = x.j GROUP BY pp.i), r AS (SELECT unnest(range(n)) AS i FROM n) SELECT r.i AS i, coalesce(y.y, 0.0) AS y FROM r LEFT JOIN y ON r.i = y.i",
    "coo_to_csr_row_ptr": f"WITH {PP_SQL}, r AS (SELECT unnest(range(n + 1)) AS i FROM n), c AS (SELECT i, count(*) AS nnz FROM pp GROUP BY i) SELECT r.i AS i, CAST(coalesce(sum(c.nnz) OVER (ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM r LEFT JOIN c ON r.i = c.i",
    "csr_entries": f"WITH {PP_SQL} SELECT i, j, v, CAST(row_number() OVER (PARTITION BY i ORDER BY j, v) - 1 AS INT) AS slot FROM pp",
    "symmetrize_general": _sym(False),
    "symmetrize_skew": _sym(True),
    "coalesce_duplicates": f"WITH {PP_SQL} SELECT i, j, sum(v) AS v FROM pp GROUP BY i, j",
    "adjacency_degree": f"WITH {PP_SQL}, {_EDGES} SELECT u, count(*) AS degree FROM edges GROUP BY u",
    "row_nnz": f"WITH {PP_SQL} SELECT i, count(*) AS nnz FROM pp GROUP BY i",
    "row_nnz_stats": f"WITH {PP_SQL}, {_ROWS} SELECT CAST(nnz AS BIGINT) AS nnz, max_row, round(avg_row, 6) AS avg_row, round(max_row / avg_row, 6) AS imbalance FROM stats",
    "kernel_choice": f"WITH {PP_SQL}, {_ROWS} SELECT CAST(nnz AS BIGINT) AS nnz, max_row, round(avg_row, 6) AS avg_row, round(max_row / avg_row, 6) AS imbalance, CASE WHEN (nnz > 1000000 AND (max_row / avg_row > 32 OR avg_row > 8)) OR avg_row > 128 THEN 'flat' ELSE 'line' END AS kernel, CASE WHEN avg_row >= 24 THEN 4 WHEN avg_row >= 8 THEN 2 ELSE 1 END AS lanes FROM stats",
    "cyclic_shards": f"WITH {PP_SQL} SELECT CAST(i % 4 AS INT) AS p, i // 4 AS li, j, v FROM pp",
    "block_shards": f"WITH {PP_SQL}, q AS (SELECT n // 4 AS s, n % 4 AS m FROM n), o AS (SELECT pp.*, s, m, CASE WHEN i < m * (s + 1) THEN i // (s + 1) ELSE m + (i - m * (s + 1)) // s END AS p FROM pp, q) SELECT CAST(p AS INT) AS p, i - (p * s + least(p, m)) AS li, j, v FROM o",
    "checkerboard_shards": f"WITH {PP_SQL} SELECT CAST(i % 2 AS INT) AS pr, CAST(j % 2 AS INT) AS pc, i // 2 AS li, j // 2 AS lj, v FROM pp",
    "ghost_sets": f"WITH {PP_SQL}, {_NEED} SELECT p, owner, lidx, CAST(slot AS INT) AS slot FROM slots",
    "ghost_need_counts": f"WITH {PP_SQL}, {_NEED}, c AS (SELECT p, owner, count(*) AS n FROM need GROUP BY p, owner) SELECT p, owner, n, CAST(coalesce(sum(n) OVER (PARTITION BY p ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displacement FROM c",
    "ghost_requests": f"WITH {PP_SQL}, {_NEED} SELECT owner AS p, p AS requester, lidx FROM need",
    "ghost_compact_columns": f"WITH {PP_SQL}, {_NEED}, a AS (SELECT CAST(i % 4 AS INT) AS p, i // 4 AS li, CAST(j % 4 AS INT) AS owner, j // 4 AS lidx, v FROM pp) SELECT a.p AS p, a.li AS li, CASE WHEN a.p = a.owner THEN a.lidx ELSE n.n // 4 + (CASE WHEN a.p < n.n % 4 THEN 1 ELSE 0 END) + s.slot END AS col, a.v AS v FROM a CROSS JOIN n LEFT JOIN slots s ON a.p = s.p AND a.owner = s.owner AND a.lidx = s.lidx",
    "ghost_fraction": f"WITH {PP_SQL}, {_NEED}, c AS (SELECT p, count(*) AS n_ghost FROM need GROUP BY p) SELECT p, n_ghost, round(n_ghost / CAST(n.n // 4 + (CASE WHEN p < n.n % 4 THEN 1 ELSE 0 END) AS DOUBLE), 9) AS ghost_fraction, round(1 - exp(-((SELECT count(*) FROM pp) / CAST(n.n AS DOUBLE)) / 4), 9) AS expected FROM c, n",
    "comm_volume": f"WITH {PP_SQL}, vol AS ({' UNION ALL '.join(_volume(p, *scalars.grid(p)) for p in (1, 2, 3, 4))}) SELECT \"P\", a AS naive_bytes, b AS ghost_bytes, c AS checkerboard_bytes, round(b / nullif(a, 0), 6) AS ghost_over_naive, round(c / nullif(a, 0), 6) AS checkerboard_over_naive, round(c / nullif(b, 0), 6) AS checkerboard_over_ghost FROM vol",
    "load_balance": f"WITH {PP_SQL} {' UNION ALL '.join(_balance(p) for p in (1, 2, 4))}",
    "nnz_balanced_split": f"""WITH {PP_SQL}, r AS (SELECT unnest(range(n)) AS g FROM n), c AS (SELECT i, count(*) AS nnz FROM pp GROUP BY i),
e AS (SELECT r.g, coalesce(sum(coalesce(c.nnz, 0)) OVER (ORDER BY r.g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r LEFT JOIN c ON r.g = c.i),
t AS (SELECT count(*) // 4 AS t FROM pp), q AS (SELECT (SELECT count(*) FROM e, t WHERE before < t) AS a, (SELECT count(*) FROM e, t WHERE before < 2 * t) AS b, (SELECT count(*) FROM e, t WHERE before < 3 * t) AS c, n FROM n),
s1 AS (SELECT least(n, greatest(a, 1)) AS x1, b, c, n FROM q), s2 AS (SELECT x1, least(n, greatest(b, x1 + 1)) AS x2, c, n FROM s1), s3 AS (SELECT x1, x2, least(n, greatest(c, x2 + 1)) AS x3, n FROM s2)
SELECT 0 AS p, CAST(0 AS BIGINT) AS start, x1 AS stop FROM s3 UNION ALL SELECT 1, x1, x2 FROM s3 UNION ALL SELECT 2, x2, x3 FROM s3 UNION ALL SELECT 3, x3, n FROM s3""",
    "flat_breakpoints": f"WITH {PP_SQL}, k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM pp) SELECT k // 1024 AS tile, min(i) AS first_row FROM k GROUP BY 1",
    "verify_almost_equal": f"WITH {PP_SQL}, y AS (SELECT pp.i, sum(pp.v * x.x) AS a FROM pp JOIN x ON pp.j = x.j GROUP BY pp.i), z AS (SELECT i, a, CASE WHEN i % 7 = 0 THEN a * 1.5 + 1 ELSE a + 0.001 END AS b FROM y) SELECT abs(a - b) <= 0.01 OR abs(a - b) <= 0.01 * greatest(abs(a), abs(b)) AS ok, count(*) AS n FROM z GROUP BY 1",
    "first_mismatches": f"WITH {PP_SQL}, y AS (SELECT pp.i, sum(pp.v * x.x) AS a FROM pp JOIN x ON pp.j = x.j GROUP BY pp.i), z AS (SELECT i, a AS y1, CASE WHEN i % 7 = 0 THEN a * 1.5 + 1 ELSE a + 0.001 END AS y2 FROM y) SELECT i, y1, y2 FROM z WHERE NOT (abs(y1 - y2) <= 0.01 OR abs(y1 - y2) <= 0.01 * greatest(abs(y1), abs(y2))) ORDER BY i LIMIT 10",
    "mtx_entries": "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "generated_rows": "SELECT family, p_partkey AS i, CAST(k AS BIGINT) AS nnz, true AS inside, CAST((p_partkey * 7919) % 1000 - 500 AS DOUBLE) AS x FROM part, (SELECT 'dense' AS family, 20 AS k UNION ALL SELECT 'low_degree', 2)",
    "embedding_spmv": "SELECT i, sum(round(CAST(v AS DOUBLE) * 1024) * (j - 33)) AS y FROM (SELECT vec_id AS i, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY i",
    "result_records": f"WITH {RECORDS_SQL} SELECT event_id * 8 + rank AS line_no, {', '.join(chr(34) + k + chr(34) for k in RECORD_KEYS)} FROM records",
    "result_lines": f"WITH {RECORDS_SQL} SELECT 'RESULT comm=' || comm || ' kernel=' || kernel || ' matrix=' || matrix || ' P=' || \"P\" || ' rank=' || rank || ' nnz_local=' || nnz_local AS line FROM records",
    "repetitions": f'WITH {RECORDS_SQL} SELECT event_id * 8 + rank AS line_no, matrix, comm, kernel, "P", rank, rep FROM reps',
    "bench_stats": f"WITH {RECORDS_SQL} SELECT comm, kernel, round(avg(total_avg_ms), 9) AS avg_ms, min(total_avg_ms) AS min_ms, max(total_avg_ms) AS max_ms, round(var_pop(total_avg_ms), 6) AS variance_ms FROM records GROUP BY comm, kernel",
    "run_figures": f"WITH {RECORDS_SQL}, b AS (SELECT *, nnz_local * 8 + (nrows_local + 1) * 4 + ncols_global * 4 + nrows_local * 4 + CAST(ceil(nnz_local / 1024.0) AS BIGINT) * 4 AS bytes FROM records) SELECT event_id, rank, bytes, round(nnz_local * 2.0 / (compute_avg_ms * 1e6), 12) AS gflops, round(bytes / (compute_avg_ms * 1e6), 12) AS gbs, round(bytes / (compute_avg_ms * 1e6) * 100.0 / 933.1, 12) AS pct_peak FROM b",
    "strong_scaling": f'WITH {TIMES_SQL} SELECT matrix, comm, kernel, "P", tm AS "T_median_ms", tl AS "T_min_ms", th AS "T_max_ms", round(t1 / tm, 9) AS speedup, round(t1 / tm / "P", 9) AS efficiency, round(gf, 9) AS aggregate_effective_gflops FROM based WHERE t1 IS NOT NULL',
    "weak_scaling": f"WITH {WEAK_SQL} SELECT * FROM weak",
    "large_matrices": f'WITH {TIMES_SQL}, f AS (SELECT matrix, comm, kernel, "P", min(nnz_local) AS nnz_min, max(nnz_local) AS nnz_max, avg(nnz_local) AS nnz_avg FROM reps WHERE rep = 0 GROUP BY ALL) SELECT matrix, comm, kernel, "P", tm AS "T_median_ms", tl AS "T_min_ms", th AS "T_max_ms", round(t1 / tm, 9) AS speedup, round(t1 / tm / "P", 9) AS efficiency, round(gf, 9) AS aggregate_effective_gflops, nnz_min, nnz_max, round(nnz_avg, 9) AS nnz_avg, round(nnz_max / nnz_avg, 9) AS imbalance FROM based JOIN f USING (matrix, comm, kernel, "P")',
    "run_balance": f"""WITH {RECORDS_SQL}, f AS (SELECT *, CASE WHEN comm IN ('bcast', 'ghost_mpi', 'ghost_nccl') THEN '1d_cyclic' WHEN comm LIKE 'checkerboard%' THEN '2d_checkerboard' END AS family FROM records),
g AS (SELECT *, row_number() OVER (PARTITION BY family, matrix, "P" ORDER BY event_id, rank) AS k FROM f WHERE family IS NOT NULL)
SELECT family, matrix, "P", min(nnz_local) AS nnz_min, round(avg(nnz_local), 9) AS nnz_avg, max(nnz_local) AS nnz_max, round(coalesce(stddev_samp(nnz_local), 0.0), 9) AS nnz_stdev, round(max(nnz_local) / avg(nnz_local), 9) AS max_over_avg, round(max(nnz_local) / CAST(min(nnz_local) AS DOUBLE), 9) AS max_over_min FROM g WHERE k <= "P" GROUP BY family, matrix, "P" """,
    "run_volume": f'WITH {RECORDS_SQL}, {VOLUME_SQL} SELECT matrix, "P", round(naive_bytes, 9) AS naive_bytes, round(ghost_bytes, 9) AS ghost_bytes, round(checkerboard_bytes, 9) AS checkerboard_bytes, round(ghost_bytes / nullif(naive_bytes, 0), 9) AS ghost_over_naive, round(checkerboard_bytes / nullif(naive_bytes, 0), 9) AS checkerboard_over_naive, round(checkerboard_bytes / nullif(ghost_bytes, 0), 9) AS checkerboard_over_ghost FROM vol',
    "summary_csv": f'WITH {TIMES_SQL} SELECT matrix, comm, kernel, "P", tm AS "T_median_ms", tl AS "T_min_ms", th AS "T_max_ms", round(t1 / tm, 9) AS speedup, round(t1 / tm / "P", 9) AS efficiency, round(gf, 9) AS aggregate_effective_gflops FROM based WHERE t1 IS NOT NULL',
    "result_files": f'WITH {RECORDS_SQL} SELECT matrix, comm, kernel, "P", rank, nnz_local, total_avg_ms, rep FROM reps',
    "mtx_file": f"WITH {PP_SQL} SELECT i, j, sum(v) AS v, count(*) AS n, (SELECT n FROM n) AS nrows FROM pp GROUP BY i, j",
    "baseline_speedup": f"WITH {TIMES_SQL}, cpu AS (SELECT concat('m', CAST(event_id % 5 AS VARCHAR), '.mtx') AS matrix, median(CAST(500 + event_id % 101 AS DOUBLE)) AS cpu_avg_ms FROM events GROUP BY 1), w AS (SELECT matrix, "
    + ", ".join(f"max(CASE WHEN comm = '{c}' AND kernel = '{k}' AND \"P\" = {p} THEN tm * (CASE WHEN matrix IN ('m0.mtx', 'm1.mtx') THEN 2 ELSE 1 END) END) AS {n}" for n, (c, k, p) in scaling.BASELINES.items())
    + " FROM based WHERE t1 IS NOT NULL GROUP BY matrix) SELECT cpu.matrix, cpu_avg_ms, "
    + ", ".join(f"round(cpu_avg_ms / {n}, 9) AS {n}" for n in scaling.BASELINES)
    + " FROM cpu LEFT JOIN w ON cpu.matrix = w.matrix",
    "kernel_isolation": f"WITH {TIMES_SQL}, w AS (SELECT matrix, \"P\", {_at('ghost_nccl', 'acc')} AS ca, {_at('ghost_nccl', 'cusparse')} AS cc, " + ", ".join(f"{_at(c + '_nccl', k)} AS {c}_{k}" for c in ("rcm", "fennel", "block") for k in KERNELS) + ' FROM times GROUP BY matrix, "P") ' + " UNION ALL ".join(f"SELECT '{c}' AS prototype, matrix, \"P\", ca AS \"T_cyclic_acc_ms\", cc AS \"T_cyclic_cusparse_ms\", {c}_acc AS \"T_prototype_acc_ms\", {c}_cusparse AS \"T_prototype_cusparse_ms\" FROM w WHERE {c}_acc IS NOT NULL OR {c}_cusparse IS NOT NULL" for c in ("rcm", "fennel", "block")),
    "weak_partitioned": f"WITH {WEAK_SQL} SELECT a.*, b.\"T_median_ms\" AS \"T_cyclic_ghost_nccl_median_ms\", round(b.\"T_median_ms\" / a.\"T_median_ms\", 9) AS speedup_vs_cyclic_ghost_nccl FROM weak a LEFT JOIN weak b ON b.comm = 'ghost_nccl' AND a.kernel = b.kernel AND a.\"P\" = b.\"P\" WHERE a.comm IN ('rcm_nccl', 'fennel_nccl', 'block_nccl')",
    "mtx_read_summary": f'WITH {READS_SQL} SELECT matrix, "P", count(*) AS n_runs, median(serial_mean_ms) AS serial_mean_ms, median(chunked_mean_ms) AS chunked_mean_ms, round(median(serial_mean_ms) / median(chunked_mean_ms), 9) AS speedup_chunked_over_serial, median(serial_read_ms) AS serial_read_ms, median(serial_distribute_ms) AS serial_distribute_ms, median(chunked_io_ms) AS chunked_io_ms, median(chunked_parse_ms) AS chunked_parse_ms, median(chunked_redistribute_ms) AS chunked_redistribute_ms, CASE WHEN count(DISTINCT chk) > 1 THEN \'MIXED:MISMATCH!,OK!\' ELSE max(chk) END AS "check" FROM reads GROUP BY matrix, "P"',
    "mtx_read_check": f'WITH {READS_SQL} SELECT matrix, "P", CAST(0 AS BIGINT) AS mismatches, bool_and(nnz_s = 1000) AS ok FROM reads GROUP BY matrix, "P"',
    "mtx_read_skipped": "SELECT count(*) FILTER (WHERE event_id % 11 = 0) AS skipped FROM events",
    "nccl_vs_mpi": f"WITH {TIMES_SQL}, r AS (SELECT matrix, \"P\", {_at('ghost_mpi', 'cusparse')} / {_at('ghost_nccl', 'cusparse')} AS r FROM times GROUP BY matrix, \"P\") SELECT \"P\", round(median(r), 9) AS mpi_over_nccl, count(*) AS n_matrices FROM r WHERE r IS NOT NULL GROUP BY \"P\"",
    "weak_efficiency_series": f"WITH {WEAK_SQL} SELECT comm, \"P\", \"E_weak\" FROM weak WHERE kernel = 'cusparse' AND comm IN ('ghost_nccl', 'checkerboard_nccl', 'rcm_nccl', 'block_nccl')",
    "structured_vs_unstructured": f"""WITH {TIMES_SQL}, r AS (SELECT matrix, avg(n_ghost) FILTER (WHERE comm = 'ghost_nccl') / avg(ncols_global) FILTER (WHERE comm = 'bcast') AS v FROM records WHERE "P" = 4 AND kernel = 'cusparse' AND matrix IN ('m0.mtx', 'm2.mtx', 'm3.mtx') GROUP BY matrix),
t AS (SELECT matrix, {_at('bcast', 'cusparse')} / {_at('ghost_nccl', 'cusparse')} AS b FROM times WHERE "P" = 4 GROUP BY matrix)
SELECT replace(r.matrix, '.mtx', '') AS matrix, CASE WHEN r.matrix = 'm3.mtx' THEN 'unstructured' ELSE 'structured' END AS category, round(v, 9) AS ghost_over_naive, round(b, 9) AS bcast_over_ghost FROM r LEFT JOIN t ON r.matrix = t.matrix""",
    "partitioner_throughput": f"WITH {TIMES_SQL} SELECT replace(matrix, '.mtx', '') AS matrix, CASE comm WHEN 'ghost_nccl' THEN 'cyclic' WHEN 'rcm_nccl' THEN 'rcm' ELSE 'block' END AS method, \"P\", round(gf, 9) AS gflops FROM times WHERE kernel = 'cusparse' AND comm IN ('ghost_nccl', 'rcm_nccl', 'block_nccl') AND matrix IN ('m0.mtx', 'm1.mtx', 'm3.mtx')",
    "partitioner_breakdown": f"""WITH {RECORDS_SQL}, c AS (SELECT * FROM (VALUES ('cyclic', 'ghost_nccl'), ('rcm', 'rcm_nccl'), ('block', 'block_nccl')) c(method, comm)), s AS (SELECT reps.*, method FROM reps JOIN c ON reps.comm = c.comm WHERE kernel = 'cusparse' AND matrix <> 'm4.mtx'),
r AS (SELECT matrix, method, rep, max(total_avg_ms) AS t, max(compute_avg_ms) AS a, max(comm_avg_ms) AS b FROM s WHERE "P" = 4 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY matrix, method ORDER BY t, rep) AS k, count(*) OVER (PARTITION BY matrix, method) AS n FROM r), m AS (SELECT DISTINCT matrix FROM s)
SELECT replace(m.matrix, '.mtx', '') AS matrix, c.method, k.a AS compute_ms, k.b AS comm_ms, CASE WHEN k.a IS NULL THEN 'OOM' END AS label FROM m CROSS JOIN c LEFT JOIN k ON m.matrix = k.matrix AND c.method = k.method AND k.k = k.n // 2 + 1""",
    "matrix_order": f"WITH {TIMES_SQL}, t AS (SELECT matrix, max(CASE WHEN comm = 'ghost_nccl' AND kernel = 'cusparse' AND \"P\" = 1 THEN tm END) AS t1 FROM times GROUP BY matrix) SELECT matrix, t1, row_number() OVER (ORDER BY t1 IS NULL, t1, matrix) AS place FROM t",
    **{f"{c}_vs_cyclic": _versus(c) for c in ("rcm", "fennel", "block")},
}

QUERIES |= linear.QUERIES | joins.QUERIES
SQL |= linear.SQL | joins.sql(RECORDS_SQL)
