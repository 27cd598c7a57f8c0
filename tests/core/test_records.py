import pytest
from pyspark.errors import AnalysisException

from meshwork.jobs import scaling
from meshwork.sources import results, summaries

KEYS = ("matrix", "comm", "kernel")


def run(matrix, comm, kernel, P, times, nnz=1000, ghosts=5, rows=100):
    return [f"RESULT comm={comm} kernel={kernel} matrix={matrix} P={P} rank={r} nrows_local={rows} ncols_global=400 nnz_local={nnz + r} n_ghost={ghosts} total_avg_ms={t} compute_avg_ms={t / 2} comm_avg_ms={t / 4} effective_gflops=2.0 new_key=a" for r, t in enumerate(times)]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    lines = ["=== job ===", "Node: n1"]
    for t in (10, 12, 11):
        lines += run("m.mtx", "ghost_nccl", "acc", 1, [t])
    for a, b in ((5, 6), (7, 4), (5, 5)):
        lines += [*run("m.mtx", "ghost_nccl", "acc", 2, [a, b]), "[kernel] acc -> flat"]
    lines += run("m.mtx", "ghost_nccl", "acc", 2, [1])  # a repetition cut short
    lines += run("m.mtx", "block_nccl", "acc", 2, [3, 4])
    lines += run("big.mtx", "bcast", "cusparse", 2, [8, 8])
    lines += ["RESULT_CSV_READ matrix=m P=1", "RESULTS are in"]
    path = tmp_path_factory.mktemp("logs") / "a.out"
    path.write_text("\n".join(lines) + "\n")
    return results.parse(results.numbered_lines(spark, str(path))).cache()


@pytest.fixture(scope="module")
def reps(records):
    return results.repetitions(records).cache()


def parsed(spark, rows):
    return results.parse(spark.createDataFrame([("f", k, x) for k, x in enumerate(rows)], "file string, line_no int, line string"))


def test_repetitions(reps):
    got = reps.groupBy("comm", "P").agg({"rep": "max", "*": "count"}).collect()
    assert {(r["comm"], r["P"]): (r["max(rep)"], r["count(1)"]) for r in got} == {("ghost_nccl", 1): (2, 3), ("ghost_nccl", 2): (2, 6), ("block_nccl", 2): (0, 2), ("bcast", 2): (0, 2)}


def test_strong_and_large(reps):
    strong = {r["P"]: r for r in scaling.strong_scaling(reps).collect()}
    assert set(strong) == {1, 2}
    assert (strong[2]["T_median_ms"], strong[2]["T_min_ms"], strong[2]["T_max_ms"]) == (6, 5, 7)
    assert strong[2]["speedup"] == 11 / 6 and strong[2]["efficiency"] == 11 / 12
    large = scaling.large_matrices(reps).collect()
    assert {(r["matrix"], r["comm"], r["speedup"] is None) for r in large} == {("m.mtx", "ghost_nccl", False), ("m.mtx", "block_nccl", True), ("big.mtx", "bcast", True)}


def test_balance_and_partitioner(records, reps):
    one = {(r["family"], r["matrix"], r["P"]): r for r in scaling.balance(records).collect()}
    assert one["1d_cyclic", "m.mtx", 1]["nnz_stdev"] == 0 and one["1d_cyclic", "m.mtx", 2]["nnz_max"] == 1001
    assert not any(k[0] is None for k in one)
    r = scaling.partition_vs_cyclic(reps, "block_nccl").first()
    assert (r["T_partitioned"], r["T_cyclic"], r["speedup"], r["ghost_fraction"]) == (4, 6, 1.5, 0.05)


def test_breakdown_labels_missing(reps):
    got = {(r["matrix"], r["method"]): (r["label"], r["compute_ms"]) for r in scaling.partitioner_breakdown(reps, (), parts=2, kernel="acc").collect()}
    assert got == {("m", "cyclic"): (None, 3), ("m", "rcm"): ("OOM", None), ("m", "block"): (None, 2)}
    assert scaling.partitioner_breakdown(reps, ("m.mtx",), parts=2, kernel="acc").count() == 0


def test_weak_scaling_pools_matrices(spark):
    """One rank, two matrices of 1 and 100 ms, three runs each."""
    lines = [x for _ in range(3) for m, t in (("a.mtx", 1), ("b.mtx", 100)) for x in run(m, "bcast", "cusparse", 1, [t])]
    r = scaling.weak_scaling(parsed(spark, lines)).first()
    assert (r["T_median_ms"], r["T_min_ms"], r["T_max_ms"], r["E_weak"]) == (50.5, 1, 100, 1)
    # two lines of different matrices are one repetition of two ranks
    lines += [*run("a.mtx", "bcast", "cusparse", 2, [4])[:1], *run("b.mtx", "bcast", "cusparse", 2, [2])]
    two = scaling.weak_scaling(parsed(spark, lines)).filter("P = 2").first()
    assert (two["T_median_ms"], two["E_weak"]) == (4, 50.5 / 4)


def test_volume_takes_the_first_transport(spark):
    mpi = run("a.mtx", "ghost_mpi", "acc", 2, [1, 1], ghosts=7)
    got = scaling.volume(parsed(spark, mpi)).first()
    assert (got["ghost_bytes"], got["naive_bytes"], got["checkerboard_bytes"]) == (28, None, None)
    lines = [*mpi, *run("a.mtx", "ghost_nccl", "acc", 2, [1, 1], ghosts=9), *run("a.mtx", "ghost_mpi", "acc", 2, [1, 1], ghosts=70), *run("a.mtx", "bcast", "acc", 2, [1, 1]), *run("a.mtx", "checkerboard_mpi", "acc", 2, [1, 1], rows=11)]
    got = scaling.volume(parsed(spark, lines)).first()
    # 400 columns over a grid of 1 x 2
    assert (got["ghost_bytes"], got["naive_bytes"], got["checkerboard_bytes"]) == (28, 1600, (200 + 11) * 4)
    assert got["ghost_over_naive"] == 28 / 1600
    assert scaling.volume(parsed(spark, list(reversed(lines)))).first()["ghost_bytes"] == 280


def test_structure(spark):
    lines = [*run("a.mtx", "bcast", "cusparse", 4, [8] * 4), *run("a.mtx", "ghost_nccl", "cusparse", 4, [2] * 4, ghosts=10), *run("a.mtx", "ghost_nccl", "cusparse", 4, [4] * 4, ghosts=30), *run("c.mtx", "bcast", "cusparse", 4, [1] * 4)]
    got = {r["matrix"]: r for r in scaling.structure(parsed(spark, lines), ("a.mtx",), ("b.mtx",)).collect()}
    assert set(got) == {"a"} and (got["a"]["category"], got["a"]["ghost_over_naive"], got["a"]["bcast_over_ghost"]) == ("structured", 20 / 400, 8 / 3)


def test_lines_of_split_files(spark, tmp_path):
    """Line numbers do not depend on how the files are split."""
    for name in ("b", "a"):
        (tmp_path / f"{name}.out").write_text("".join(f"RESULT P=1 rank={k} comm={name}\n" + "noise\n" * (k % 3) for k in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = results.parse(results.numbered_lines(spark, str(tmp_path))).orderBy("file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["comm"], r["line_no"], r["rank"]) for r in got] == [(c, k, k) for c in "ab" for k in range(500)]


def test_summaries(spark, tmp_path):
    summary = spark.createDataFrame([("b", "x", "k", 1, 2.5, 1.0, 3.0, None, 0.1, 7.0), ("a", "x", "k", 2, 0.1, 1.0, 3.0, 1 / 3, 0.1, 7.0)], summaries.SCHEMAS["strong_scaling"])
    path = str(tmp_path / "s")
    summaries.write(summary, path, ("matrix", "P"))
    [file] = (tmp_path / "s").glob("*.csv")
    assert file.read_text().splitlines()[:2] == [",".join(summary.columns), "a,x,k,2,0.1,1.0,3.0,0.3333333333333333,0.1,7.0"]
    assert sorted(map(tuple, summaries.read(spark, path, "strong_scaling").collect()), key=str) == sorted(map(tuple, summary.collect()), key=str)
    other = tmp_path / "t.csv"
    other.write_text("P,matrix,comm,kernel,T_median_ms,speedup\n2,a,x,k,9,nan\n")
    later = summaries.read(spark, str(other), "strong_scaling")
    assert later.first()["speedup"] is None and later.first()["efficiency"] is None
    keys = ("matrix", "comm", "kernel", "P")
    both = {r["matrix"]: r["T_median_ms"] for r in summaries.merged([summaries.read(spark, path, "strong_scaling"), None, later], keys).collect()}
    assert both == {"b": 2.5, "a": 9}
    assert summaries.read(spark, str(tmp_path / "no"), "baseline", required=False) is None and summaries.merged([None], keys) is None
    with pytest.raises(AnalysisException):
        summaries.read(spark, str(tmp_path / "no"), "baseline")
    serial = spark.createDataFrame([("a", 18.0), ("z", 1.0)], "matrix string, avg_ms double")
    times = spark.createDataFrame([("a", "ghost_mpi", "cusparse", 4, 9.0)], "matrix string, comm string, kernel string, P int, T_median_ms double")
    assert {r["matrix"]: r["speedup_ghost_cusparse_P4"] for r in scaling.baseline_speedups(serial, times).collect()} == {"a": 2, "z": None}
    assert scaling.baseline_speedups(serial, None).filter("speedup_bcast_cusparse_P1 IS NULL").count() == 2


def test_reads(spark):
    line = "RESULT_CSV_READ matrix=m P=2 reps=3 serial_mean_ms={s} chunked_mean_ms=2 nnz_total_serial=5 nnz_total_chunked=5 spmv_mismatches=0 check={c}"
    rows = [line.format(s=4, c="OK!"), line.format(s=8, c="MISMATCH!"), "RESULT_CSV_READ matrix=m P=2 mpiio_mean_ms=3 check=OK!", "noise"]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(rows)], "file string, line_no int, line string")
    reads = results.parse_reads(lines)
    r = scaling.reading(reads).first()
    assert (r["n_runs"], r["serial_mean_ms"], r["speedup_chunked_over_serial"], r["check"]) == (2, 6, 3, "MIXED:MISMATCH!,OK!")
    assert results.old_reads(lines).first()["skipped"] == 1
    assert scaling.read_check(reads).first()["ok"]


def test_odd_tokens(spark):
    rows = ["RESULT P=x comm=a comm=b matrix=p=q kernel", "RESULT ", "result P=1", "RESULT P=2 comm=c", 'RESULT kernel="a\\b"  x matrix=\u00e9 total_avg_ms=1e1 P=3']
    got = parsed(spark, rows).orderBy("line_no").collect()
    assert [(r["P"], r["comm"]) for r in got] == [(None, "b"), (None, None), (2, "c"), (3, None)]
    assert (got[3]["kernel"], got[3]["matrix"], got[3]["total_avg_ms"]) == ('"a\\b"', "\u00e9", 10)
    assert results.repetitions(parsed(spark, [])).count() == 0


def test_white_space_and_the_order_of_a_list(spark, tmp_path):
    """Lines may be indented by any white space; files of a list come in its
    order, not by name, so repetitions follow it."""
    one, two = tmp_path / "a.out", tmp_path / "b.out"
    one.write_text("".join(f"\t {x}\r\n" for x in run("m.mtx", "bcast", "acc", 1, [1])))
    two.write_text("".join(f"\x0b{x}  \n" for x in run("m.mtx", "bcast", "acc", 1, [2])))
    reps = lambda paths: {r["rep"]: r["total_avg_ms"] for r in results.repetitions(results.parse(results.numbered_lines(spark, paths))).collect()}
    assert reps([str(one), str(two)]) == {0: 1, 1: 2} and reps([str(two), str(one)]) == {0: 2, 1: 1} and reps(str(tmp_path)) == {0: 1, 1: 2}
    # a file named twice counts twice
    assert reps([str(one), str(two), str(one)]) == {0: 1, 1: 2, 2: 1}


def test_malformed_values_are_reported(spark):
    lines = spark.createDataFrame([("f", 0, "RESULT P=x rank=1 gflops=1e3 nnz_local=1.5 comm=9"), ("f", 1, "RESULT P=2"), ("f", 2, "other P=y")], "file string, line_no int, line string")
    assert sorted((r["line_no"], r["key"], r["value"]) for r in results.malformed(lines).collect()) == [(0, "P", "x"), (0, "nnz_local", "1.5")]
