"""Solvers, sparse products, block storage and the data source against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.jobs import linear
from meshwork.operators import solvers, spmm
from meshwork.operators.matrix import ShapeError, SparseMatrix
from meshwork.sources import blocks, datasource
from tests.core.helpers import shuffled_rows


def matrix(spark, n, m, nnz, seed=1, hot=None):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(n), rnd.randrange(m) if hot is None or rnd.random() < 0.5 else hot, float(rnd.randint(1, 9))) for _ in range(nnz)]
    dense = np.zeros((n, m))
    for i, j, v in rows:
        dense[i, j] += v
    return SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double").repartition(3), n, m), dense


def vector(df, n, key="j", value="x"):
    out = np.zeros(n)
    for r in df.collect():
        out[r[key]] = r[value]
    return out


@pytest.mark.parametrize("hub", [3, 10**6])
def test_power_iteration(spark, hub, monkeypatch):
    monkeypatch.setattr(solvers, "HUB", hub)
    m, a = matrix(spark, 30, 30, 400, hot=4)
    x, value = solvers.power_iteration(SparseMatrix(m.df.union(m.df.selectExpr("j", "i", "v")), 30, 30), 60, 1e-10)
    values, vectors = np.linalg.eigh(a + a.T)
    k = np.argmax(abs(values))
    assert abs(value - values[k]) < 1e-6 * abs(values[k])
    assert abs(abs(vector(x, 30) @ vectors[:, k]) - 1) < 1e-3


def test_pagerank(spark):
    m, a = matrix(spark, 25, 25, 60, hot=3)
    p = (a > 0).astype(float)
    out, rank = p.sum(axis=1), np.full(25, 1 / 25)
    for _ in range(200):
        y = (p / np.maximum(out, 1)[:, None]).T @ rank
        rank = 0.15 / 25 + 0.85 * (y + rank[out == 0].sum() / 25)
    got = vector(solvers.pagerank(m, tol=1e-9), 25, value="rank")
    assert np.allclose(got, rank, atol=1e-8) and abs(got.sum() - 1) < 1e-9


def test_conjugate_gradients(spark):
    m, _ = matrix(spark, 20, 20, 40, seed=5)
    lap = solvers.laplacian(m)
    dense = np.zeros((20, 20))
    for r in lap.df.collect():
        dense[r["i"], r["j"]] += r["v"]
    b = [(k, float(k % 7 - 3)) for k in range(0, 20, 2)]
    x, steps, residual = solvers.conjugate_gradients(lap, spark.createDataFrame(b, "j long, x double"))
    assert steps <= 25 and residual <= 1e-8
    right = np.zeros(20)
    right[[k for k, _ in b]] = [v for _, v in b]
    assert np.allclose(vector(x, 20), np.linalg.solve(dense, right), atol=1e-6)
    with pytest.raises(ValueError):
        solvers.conjugate_gradients(SparseMatrix(spark.createDataFrame([(0, 0, -1.0)], "i long, j long, v double"), 1, 1), spark.createDataFrame([(0, 1.0)], "j long, x double"))


def test_a_step_shuffles_the_vector_only(spark):
    """The stored entries reach their join without an exchange."""
    m, _ = matrix(spark, 50, 50, 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = solvers.stored_by_column(m)
        y = a.times(spark.range(50).selectExpr("id AS j", "1.0D AS x"))
        plan = y._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(k for k, x in enumerate(lines) if "Bucketed: true" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        join = max(k for k, x in enumerate(lines[:scan]) if "SortMergeJoin" in x and depth(x) < depth(lines[scan]))
        between = [x for k, x in enumerate(lines[join:scan], join) if depth(lines[join]) < depth(x) < depth(lines[scan])]
        side = lines[join + 1 : scan]
        assert not any("Exchange" in x for x in side), plan
        assert between is not None and y.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("cell", [3, 4096])
def test_spmm(spark, cell):
    a, da = matrix(spark, 12, 20, 150, hot=2)
    b, db = matrix(spark, 20, 9, 150, seed=2, hot=5)
    got = np.zeros((12, 9))
    rows = spmm.spmm(a, b, cell).df.collect()
    for r in rows:
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, da @ db) and len(rows) == len({(r["i"], r["j"]) for r in rows})
    s = spmm.products(a, b).first()
    na, nb = [a.df.filter(F.col("j") == k).count() for k in (2, 5)], [b.df.filter(F.col("i") == k).count() for k in (2, 5)]
    assert s["n_products"] >= na[0] * nb[0] and s["most_cells"] == min(s["n_products"], 12 * 9)
    with pytest.raises(ShapeError):
        spmm.spmm(a, a)


def test_spmm_shuffles_entries_not_products(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3000), k, 1.0) for k in range(40) for _ in range(120)]
    m = SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double").repartition(4), 3000, 40)
    before = shuffled_rows(spark)
    cells = spmm.spmm(m, spmm.transposed(m)).df.count()
    assert cells > 20 * len(rows) and shuffled_rows(spark) - before < 6 * len(rows)


@pytest.mark.parametrize("same", [True, False])
def test_spmm_parts_and_pieces(spark, monkeypatch, same):
    """Many parts, ranges of rows in pieces of columns, sums in steps, nulls,
    values and indices of all widths, duplicates."""
    for name, n in (("RANGES", 8), ("PART", 300), ("STEP", 100), ("HELD", 150)):
        monkeypatch.setattr(spmm, name, n)
    rnd = random.Random(6)
    index = lambda: rnd.choice([None, 0, 1, 1, 1, 2, 5, 7, 300, 70_000, 3 << 33, -4])
    value = lambda: rnd.choice([None, 0.0, -0.0, 1.0, 2.0, -3.0, 0.25, 0.1, 300.0])
    a = [(index(), rnd.choice([None, 1, 1, 2, 3, 4]), value()) for _ in range(160)]
    b = [(j, i, v) for i, j, v in a] if same else [(rnd.choice([None, 1, 2, 9]), index(), value()) for _ in range(120)]
    want = {}
    for i, k, v in a:
        for h, j, w in b:
            if k is not None and k == h:
                n, total = want.get((i, j), (0, 0.0))
                want[i, j] = (n, total) if v is None or w is None else (n + 1, total + v * w)
    m = SparseMatrix(spark.createDataFrame(a, "i long, j long, v double").repartition(3), 1 << 35, 10)
    other = spmm.transposed(m) if same else SparseMatrix(spark.createDataFrame(b, "i long, j long, v double").repartition(2), 10, 1 << 35)
    for cell in (4096, 20):
        rows = spmm.spmm(m, other, cell).df.collect()
        got = {(r["i"], r["j"]): r["v"] for r in rows}
        assert len(got) == len(rows) and got.keys() == want.keys()
        assert all((got[c] is None) == (n == 0) and (n == 0 or got[c] == pytest.approx(x, rel=1e-9, abs=1e-9)) for c, (n, x) in want.items())
    empty = SparseMatrix(m.df.limit(0), m.nrows, m.ncols)
    assert spmm.spmm(empty, spmm.transposed(empty)).df.count() == 0
    whole = SparseMatrix(m.df.withColumn("v", F.lit(2)), m.nrows, m.ncols)
    back = spmm.spmm(whole, spmm.transposed(whole)).df
    assert dict(back.dtypes)["v"] == "bigint" and back.agg(F.sum("v")).first()[0] == 4 * spmm.products(whole, spmm.transposed(whole)).first()["n_products"]


@pytest.mark.parametrize("kind", ["double", "decimal(12,2)"])
def test_spmm_transpose_of_any_quantity(spark, tmp_path, kind):
    """The stored PP goes only when the result needs it no more."""
    rows = [(k // 3, k % 7, 0, k % 3, float(k % 5), 1.0) for k in range(60)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, names).withColumn("l_quantity", F.col("l_quantity").cast(kind)).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(7).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    pp = [(i, j, v) for (o, i, _, _, v, _), (q, j, *_) in zip(rows, rows[1:], strict=False) if o == q]
    want = {}
    for i, k, v in pp:
        for j, h, w in pp:
            if k == h:
                want[i, j] = want.get((i, j), 0) + v * w
    got = linear.QUERIES["spmm_transpose"](spark, str(tmp_path)).collect()
    assert {(r["i"], r["j"]): float(r["v"]) for r in got} == want and len(got) == len(want)


def test_blocks(spark, tmp_path):
    m, dense = matrix(spark, 100, 90, 900, hot=7)
    blocks.write(m, str(tmp_path), size=10, band=2, piece=20)
    b = blocks.Blocks(spark, str(tmp_path))
    assert sorted(map(tuple, b.entries().collect())) == sorted(map(tuple, m.df.collect()))
    assert b.table.agg(F.max("nnz")).first()[0] < 60 and b.table.filter("piece > 0").count() > 0
    x = spark.range(90).selectExpr("id AS j", "CAST(id % 5 - 2 AS DOUBLE) AS x")
    y = vector(b.product(x, (33, 61), (5, 48)), 100, "i", "y")
    part = np.zeros((100, 90))
    part[33:61, 5:48] = dense[33:61, 5:48]
    assert np.allclose(y, part @ (np.arange(90) % 5 - 2))
    got = b.catalog().agg(F.sum("nnz"), F.min("row_lo"), F.max("col_hi")).first()
    assert got[0] == 900
    with pytest.raises(ShapeError):
        b.within(rows=(0, 101))


def test_a_range_reads_its_blocks_only(spark, tmp_path):
    m, _ = matrix(spark, 400, 400, 20_000)
    blocks.write(m, str(tmp_path), size=10, band=1)
    b = blocks.Blocks(spark, str(tmp_path))

    def files(df):
        df.collect()
        scans = [df._jdf.queryExecution().executedPlan()]
        found = 0
        while scans:
            p = scans.pop()
            if "AdaptiveSparkPlan" in p.nodeName():
                p = p.executedPlan()
            if p.metrics().contains("numFiles"):
                found += p.metrics().apply("numFiles").value()
            kids = p.children()
            scans += [kids.apply(k) for k in range(kids.size())]
        return found

    whole, part = files(b.entries()), files(b.entries(rows=(100, 120)))
    assert 0 < part <= whole // 10
    some = b.entries(rows=(100, 120), cols=(0, 40))
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(bj" in plan


FILES = {
    "general": ("%%MatrixMarket matrix coordinate real general\n% c\n\n3 3 4\n1 1 1.5\n2 3 -2\n% inner\n\n3 1 4e2\r\n1 1 1.5", [(0, 0, 1.5), (0, 0, 1.5), (1, 2, -2.0), (2, 0, 400.0)]),
    "symmetric": ("%%MatrixMarket MATRIX Coordinate Real Symmetric\n3 3 3\n1 1 1\n2 1 5\n3 2 7\n", [(0, 0, 1.0), (0, 1, 5.0), (1, 0, 5.0), (1, 2, 7.0), (2, 1, 7.0)]),
    "skew": ("%%MatrixMarket matrix coordinate integer skew-symmetric\n2 2 1\n2 1 3\n", [(0, 1, -3.0), (1, 0, 3.0)]),
    "pattern": ("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n", [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]),
    "none": ("%%MatrixMarket matrix coordinate real general\n4 4 0\n", []),
}


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
@pytest.mark.parametrize("name", FILES)
def test_source_reads(spark, tmp_path, name, split):
    text, want = FILES[name]
    (tmp_path / "m.mtx").write_text(text)
    datasource.register(spark)
    df = spark.read.format("mtx").option("split_bytes", split).load(str(tmp_path / "m.mtx"))
    assert sorted(map(tuple, df.collect())) == want


def test_source_ranges_and_errors(spark, tmp_path):
    from meshwork.sources.mtx import MatrixMarketError

    m, _ = matrix(spark, 300, 200, 3000)
    datasource.register(spark)
    path = str(tmp_path / "m")
    m.df.write.format("mtx").option("nrows", 300).option("ncols", 200).mode("append").save(path)
    one = str(tmp_path / "one.mtx")
    m.df.write.format("mtx").options(nrows=300, ncols=200, single="true").mode("append").save(one)
    want = sorted(map(tuple, m.df.collect()))
    for p, split in ((path, 777), (one, 1000), (one, 1 << 26)):
        df = spark.read.format("mtx").option("split_bytes", split).load(p)
        assert sorted(map(tuple, df.collect())) == want
    assert (tmp_path / "one.mtx").read_text().startswith("%%MatrixMarket matrix coordinate real general\n300 200 3000\n")
    assert not any("_" in p.name[:1] for p in (tmp_path / "m").iterdir())
    (tmp_path / "bad.mtx").write_text("%MatrixMarket matrix\n")
    with pytest.raises(MatrixMarketError):
        datasource.MtxReader({"path": str(tmp_path / "bad.mtx")})
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 1 -2\n")
    got = spark.read.format("mtx").load(str(tmp_path / "c.mtx")).collect()
    assert sorted((r["i"], r["j"], r["v"]["re"], r["v"]["im"]) for r in got) == [(0, 1, 1.0, 2.0), (1, 0, 1.0, -2.0)]


def test_phases_are_read_back(spark, tmp_path):
    from meshwork.jobs import phases

    m, _ = matrix(spark, 40, 40, 500)
    x = spark.range(40).selectExpr("id AS j", "1.0D AS x")
    lines = [phases.product_line(m, x, "m", exchange, "line", 4) for exchange in ("plain", "checkerboard")]
    rows = {r["comm"]: r for r in phases.written_lines(spark, lines, str(tmp_path / "log")).collect()}
    assert set(rows) == {"plain", "checkerboard"}
    for r in rows.values():
        assert r["nnz_local"] == 500 and r["nrows_local"] == m.df.select("i").distinct().count() and r["total_avg_ms"] > 0 and r["compute_avg_ms"] > 0
    p = phases.measured(m.df.groupBy("i").count())
    assert p.tasks > 0 and p.shuffled > 0 and p.total_ms > 0
