"""Registered queries of the solvers, sparse products and block storage on the
driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import forget, fresh_path, written
from ..operators import solvers, spmm
from ..operators.matrix import SparseMatrix
from ..sources import blocks, datasource
from . import phases
from .matrices import PP_SQL, Query, pp_matrix, x_vector

STEPS, CG_STEPS = 10, 6
SIZE, BAND = 64, 4


def _pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return solvers.pagerank(pp_matrix(spark, sf), STEPS, tol=0).select("j", F.round("rank", 12).alias("rank"))


def _power(spark: SparkSession, sf: str) -> DataFrame:
    x, value = solvers.power_iteration(pp_matrix(spark, sf), STEPS, tol=0)
    return x.select("j", F.round("x", 9).alias("x"), F.round(F.lit(value), 6).alias("eigenvalue"))


def _gradients(spark: SparkSession, sf: str) -> DataFrame:
    x, _, _ = solvers.conjugate_gradients(solvers.laplacian(pp_matrix(spark, sf)), x_vector(spark, sf), CG_STEPS, tol=0)
    return x.select("j", F.round("x", 6).alias("x"))


def _squared(spark: SparkSession, sf: str) -> DataFrame:
    """PP times its transpose; PP is stored, as several passes read it."""
    m = pp_matrix(spark, sf)
    kept = SparseMatrix(written(m.df, "pp"), m.nrows, m.ncols)
    out = spmm.spmm(kept, spmm.transposed(kept)).df
    if not {*kept.df.inputFiles()} & {*out.inputFiles()}:
        forget(kept.df)
    return out


def _estimate(spark: SparkSession, sf: str) -> DataFrame:
    m = pp_matrix(spark, sf)
    return spmm.products(m, spmm.transposed(m))


def stored(spark: SparkSession, sf: str) -> blocks.Blocks:
    path = fresh_path(spark, "blocks")
    blocks.write(pp_matrix(spark, sf), path, SIZE, BAND)
    return blocks.Blocks(spark, path)


def _range_product(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the second quarter against columns of the first half."""
    b = stored(spark, sf)
    return b.product(x_vector(spark, sf), (b.nrows // 4, b.nrows // 2), (0, b.ncols // 2))


def _source(spark: SparkSession, sf: str) -> DataFrame:
    """PP written and read by the data source ``mtx``, in ranges of 64 KB."""
    datasource.register(spark)
    m, path = pp_matrix(spark, sf), fresh_path(spark, "source")
    m.df.write.format("mtx").option("nrows", m.nrows).option("ncols", m.ncols).mode("append").save(path)
    back: SparseMatrix = SparseMatrix(spark.read.format("mtx").option("split_bytes", 1 << 16).load(path), m.nrows, m.ncols)
    return back.df.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


PHASED = (("plain", "line"), ("broadcast", "line"), ("checkerboard", "line"), ("plain", "flat"))


def _phases(spark: SparkSession, sf: str) -> DataFrame:
    """Products of PP as RESULT lines in a log, and the records read back."""
    m, x = pp_matrix(spark, sf), x_vector(spark, sf)
    lines = [phases.product_line(m, x, "pp", exchange, kernel, 4) for exchange, kernel in PHASED]
    rows = phases.written_lines(spark, lines, fresh_path(spark, "phases"))
    timed = (F.col("total_avg_ms") > 0) & (F.col("compute_avg_ms") > 0) & (F.col("comm_avg_ms") >= 0) & (F.col("effective_gflops") > 0)
    return rows.select("comm", "kernel", "matrix", "nnz_local", "nrows_local", timed.alias("timed"))


QUERIES: dict[str, Query] = {
    "product_phases": _phases,
    "pagerank": _pagerank,
    "power_iteration": _power,
    "conjugate_gradients": _gradients,
    "spmm_transpose": _squared,
    "spmm_products": _estimate,
    "block_catalog": lambda spark, sf: stored(spark, sf).catalog(),
    "block_range_product": _range_product,
    "mtx_source": _source,
}


def _chain(first: str, step, n: int) -> str:
    """r0, and r1 to rn, each made from the one before."""
    return ", ".join([f"r0 AS MATERIALIZED ({first})", *(f"r{k + 1} AS MATERIALIZED ({step(f'r{k}')})" for k in range(n))])


def _rank_step(r: str) -> str:
    return f"""SELECT r.j, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * l.lost / n + 0.85::DOUBLE * coalesce(t.y, 0) AS x FROM {r} r CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(x), 0) AS lost FROM {r} WHERE j NOT IN (SELECT i FROM degree)) l
LEFT JOIN (SELECT e.j, sum(s.x / d.d) AS y FROM edges e JOIN degree d ON e.i = d.i JOIN {r} s ON s.j = e.i GROUP BY e.j) t ON t.j = r.j"""


def _power_step(r: str) -> str:
    return f"SELECT j, y / sqrt(sum(y * y) OVER ()) AS x, sum(x * y) OVER () AS value FROM (SELECT r.j, r.x, coalesce(t.y, 0) AS y FROM {r} r LEFT JOIN (SELECT pp.i, sum(pp.v * s.x) AS y FROM pp JOIN {r} s ON pp.j = s.j GROUP BY pp.i) t ON t.i = r.j)"


def _gradient_step(r: str) -> str:
    return f"""SELECT j, x + a * p AS x, r - a * q AS r, (r - a * q) + (sum((r - a * q) * (r - a * q)) OVER () / rr) * p AS p
FROM (SELECT *, rr / sum(p * q) OVER () AS a FROM (SELECT s.j, s.x, s.r, s.p, coalesce(t.q, 0) AS q, sum(s.r * s.r) OVER () AS rr FROM {r} s LEFT JOIN (SELECT l.i, sum(l.v * z.p) AS q FROM lap l JOIN {r} z ON l.j = z.j GROUP BY l.i) t ON t.i = s.j))"""


_PP = PP_SQL.replace("pp AS (", "pp AS MATERIALIZED (", 1)
_LAP = "e AS (SELECT i AS u, j AS v FROM pp WHERE i <> j UNION SELECT j, i FROM pp WHERE i <> j), lap AS MATERIALIZED (SELECT u AS i, v AS j, -1.0::DOUBLE AS v FROM e UNION ALL SELECT g.g, g.g, 1.0::DOUBLE + coalesce(d.d, 0) FROM (SELECT unnest(range(n)) AS g FROM n) g LEFT JOIN (SELECT u, count(*) AS d FROM e GROUP BY u) d ON d.u = g.g)"

_PHASED = " UNION ALL ".join(f"SELECT '{e}' AS comm, '{k}' AS kernel" for e, k in PHASED)

SQL: dict[str, str] = {
    "product_phases": f"WITH {_PP}, r AS ({_PHASED}) SELECT comm, kernel, 'pp' AS matrix, (SELECT count(*) FROM pp) AS nnz_local, (SELECT count(DISTINCT i) FROM pp) AS nrows_local, true AS timed FROM r",
    "pagerank": f"WITH {_PP}, edges AS MATERIALIZED (SELECT DISTINCT i, j FROM pp), degree AS MATERIALIZED (SELECT i, count(*) AS d FROM edges GROUP BY i), {_chain('SELECT unnest(range(n)) AS j, 1.0::DOUBLE / n AS x FROM n', _rank_step, STEPS)} SELECT j, round(x, 12) AS rank FROM r{STEPS}",
    "power_iteration": f"WITH {_PP}, {_chain('SELECT unnest(range(n)) AS j, 1.0::DOUBLE / sqrt(n) AS x, 0.0::DOUBLE AS value FROM n', _power_step, STEPS)} SELECT j, round(x, 9) AS x, round(value, 6) AS eigenvalue FROM r{STEPS}",
    "conjugate_gradients": f"WITH {_PP}, {_LAP}, {_chain('SELECT g.g AS j, 0.0::DOUBLE AS x, coalesce(x.x, 0) AS r, coalesce(x.x, 0) AS p FROM (SELECT unnest(range(n)) AS g FROM n) g LEFT JOIN x ON x.j = g.g', _gradient_step, CG_STEPS)} SELECT j, round(x, 6) AS x FROM r{CG_STEPS}",
    "spmm_transpose": f"WITH {_PP} SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS v FROM pp a JOIN pp b ON a.j = b.j GROUP BY a.i, b.i",
    "spmm_products": f"WITH {_PP}, k AS (SELECT j, count(*) AS c FROM pp GROUP BY j) SELECT count(*) AS n_keys, CAST(sum(c * c) AS BIGINT) AS n_products, CAST(max(c * c) AS BIGINT) AS most, least(CAST(sum(c * c) AS DOUBLE), (SELECT CAST(n AS DOUBLE) * n FROM n)) AS most_cells FROM k",
    "block_catalog": f"WITH {_PP} SELECT i // {SIZE} AS bi, j // {SIZE} AS bj, count(*) AS nnz, min(i) AS row_lo, max(i) AS row_hi, min(j) AS col_lo, max(j) AS col_hi FROM pp GROUP BY ALL",
    "block_range_product": f"WITH {_PP} SELECT pp.i AS i, sum(pp.v * x.x) AS y FROM pp JOIN x ON pp.j = x.j, n WHERE pp.i >= n // 4 AND pp.i < n // 2 AND pp.j < n // 2 GROUP BY pp.i",
    "mtx_source": f"WITH {_PP} SELECT i, j, sum(v) AS v, count(*) AS n FROM pp GROUP BY i, j",
}
