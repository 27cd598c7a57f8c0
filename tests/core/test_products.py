import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import scalars, tables
from meshwork.functions.tables import ranked
from meshwork.operators import matrix, partition, spmv
from meshwork.operators.components import components
from meshwork.operators.matrix import ShapeError, SparseMatrix

N = 23


@pytest.fixture(scope="module")
def entries():
    rnd = random.Random(7)
    e = [(rnd.randrange(N), int(N * rnd.random() ** 2), float(rnd.randint(-9, 9))) for _ in range(160)]
    return [x for x in e if 17 not in x[:2]] + [(3, 3, 2.0), (3, 3, 2.0), (21, 0, 1.0)]


@pytest.fixture(scope="module")
def m(spark, entries):
    return SparseMatrix(spark.createDataFrame(entries, "i long, j long, v double").cache(), N, N)


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(j, float(j * 7919 % 1000 - 500)) for j in range(N)], "j long, x double").cache()


@pytest.fixture(scope="module")
def want(entries):
    y = {}
    for i, j, v in entries:
        y[i] = y.get(i, 0.0) + v * (j * 7919 % 1000 - 500)
    return y


def rows(df):
    return {r["i"]: r["y"] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("exchange", ["ghost", "checkerboard"])
def test_exchanges(m, x, want, exchange, parts):
    assert rows(spmv.spmv(m, x, exchange=exchange, parts=parts)) == want


@pytest.mark.parametrize("kernel", ["line", "flat"])
@pytest.mark.parametrize("exchange", ["plain", "broadcast", "ghost"])
def test_kernels(m, x, want, exchange, kernel):
    assert rows(spmv.spmv(m, x, exchange=exchange, kernel=kernel)) == want


@pytest.mark.parametrize("make", [lambda m: partition.assign_block(m.df.sparkSession, N, 4), lambda m: partition.assign_rcm(m, 4)[0], lambda m: partition.assign_greedy(m, 4)])
def test_assignments(m, x, want, make):
    a = make(m).cache()
    assert sorted(r["g"] for r in a.collect()) == list(range(N))
    places = {}
    for r in a.collect():
        places.setdefault(r["owner"], []).append(r["lidx"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(4))
    assert rows(spmv.spmv(m, x, exchange="ghost", assignment=a)) == want


def test_dense(m, x, want):
    assert rows(spmv.dense(spmv.spmv(m, x), N)) == {i: want.get(i, 0.0) for i in range(N)}


def test_rectangular(spark, x):
    m = SparseMatrix(spark.createDataFrame([(0, 1, 2.0)], "i long, j long, v double"), 5, N)
    assert rows(spmv.spmv(m, x, exchange="broadcast")) == {0: 2.0 * (7919 % 1000 - 500)}
    for how in ("ghost", "checkerboard"):
        with pytest.raises(ShapeError):
            spmv.spmv(m, x, exchange=how)
    with pytest.raises(ShapeError):
        partition.rcm_order(m)
    with pytest.raises(ShapeError):
        SparseMatrix(m.df, 1, 1).checked()


def cuthill_mckee(n, edges):
    """The sequential order with a queue, ties by degree and index, reversed."""
    near = {k: set() for k in range(n)}
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    key = lambda u: (len(near[u]), u)
    order, seen = [], set()
    for s in sorted(range(n), key=key):
        if s in seen:
            continue
        queue = [s]
        seen.add(s)
        while queue:
            u = queue.pop(0)
            order.append(u)
            for v in sorted(near[u] - seen, key=key):
                seen.add(v)
                queue.append(v)
    return {g: n - 1 - k for k, g in enumerate(order)}


def test_rcm(m, entries):
    assert {r["g"]: r["pos"] for r in partition.rcm_order(m).collect()} == cuthill_mckee(N, [e[:2] for e in entries])


def _shapes():
    """Edges of a long path, of rings, of chains between two hubs and of a grid."""
    yield "path", [(k, k + 1) for k in range(3000)]
    yield "rings", [(k, (k + 1) % 5) for k in range(5)] + [(5 + k, 5 + (k + 1) % 6) for k in range(6)]
    chains, n = [], 2
    for length, end in ((3, 1), (4, 1), (7, 1), (12, 1), (13, 1), (1, 1), (5, 0), (6, 0)):
        at = 0
        for _ in range(length):
            chains.append((at, n))
            at, n = n, n + 1
        chains.append((at, end))
    yield "chains", chains
    yield "grid", [(12 * r + c, 12 * r + c + d) for r in range(12) for c in range(12) for d in (1, 12) if (c < 11 if d == 1 else r < 11)]


@pytest.mark.parametrize("shape", ["path", "rings", "chains", "grid"])
def test_rcm_over_chains(spark, shape):
    e = dict(_shapes())[shape]
    n = max(map(max, e)) + 2  # one vertex without edges
    names = list(range(n))
    random.Random(1).shuffle(names)
    e = [(names[a], names[b]) for a, b in e]
    m = SparseMatrix(spark.createDataFrame([(a, b, 1.0) for a, b in e], "i long, j long, v double"), n, n)
    pos = {r["g"]: r["pos"] for r in partition.rcm_order(m, window=4).collect()}
    assert pos == cuthill_mckee(n, e)
    if shape == "path":
        assert all(abs(pos[a] - pos[b]) == 1 for a, b in e)


@pytest.mark.parametrize(("n", "e"), [(0, []), (3, []), (3, [(1, 1)]), (4, [(0, 1), (1, 2), (2, 0), (2, 0), (0, 0)])])
def test_rcm_of_few(spark, n, e):
    m = SparseMatrix(spark.createDataFrame([(a, b, 1.0) for a, b in e], "i long, j long, v double"), n, n)
    assert {r["g"]: r["pos"] for r in partition.rcm_order(m).collect()} == cuthill_mckee(n, e)


@pytest.mark.parametrize("nnz", [[1] * 10, [100] + [1] * 9, [1] * 9 + [100], [0] * 10, [5, 0, 0, 7, 3, 0, 1, 1, 9, 2]])
def test_balanced_split(spark, nnz):
    parts, total = 4, sum(nnz)
    rows_ = spark.createDataFrame(list(enumerate(nnz)), "g long, nnz long")
    placed, starts = partition.balanced_split(rows_, len(nnz), parts, [F.col("g")])
    want, load, at = [0], 0, 0
    for r in range(parts - 1):  # block by block, at least a row each
        first = True
        while at < len(nnz) and (first or load < total // parts * (r + 1)):
            load += nnz[at]
            at += 1
            first = False
        want.append(at)
    assert starts == [*want, len(nnz)]
    assert partition.split_assignment(placed, starts).count() == len(nnz)


def test_ghosts(m, entries):
    for parts in (1, 2, 4):
        need = {(r["p"], r["owner"], r["lidx"]): r["slot"] for r in partition.ghost_need(m.df, parts).collect()}
        want = {(i % parts, j % parts, j // parts) for i, j, _ in entries if i % parts != j % parts}
        assert set(need) == want
        for p in range(parts):
            own = sorted(k for k in need if k[0] == p)
            assert [need[k] for k in own] == list(range(len(own)))
        assert partition.ghost_requests(m.df, parts).count() == len(want)
    n_local = {p: scalars.local_rows(N, 4, p) for p in range(4)}
    cols = partition.compact_columns(m, 4).collect()
    assert len(cols) == len(entries) and all(r["col"] >= 0 for r in cols)
    ghosts = {p: {r["col"] for r in cols if r["p"] == p and r["col"] >= n_local[p]} for p in range(4)}
    assert all(g == set(range(n_local[p], n_local[p] + len(g))) for p, g in ghosts.items())


def test_pointers_and_slots(m, entries):
    ptr = [r["row_ptr"] for r in matrix.row_pointers(m).orderBy("i").collect()]
    assert ptr == [sum(1 for e in entries if e[0] < i) for i in range(N + 1)]
    slots = matrix.csr_entries(m).orderBy("i", "slot").collect()
    assert [(r["i"], r["j"]) for r in slots] == sorted(e[:2] for e in entries)


def test_breakpoints(m, entries):
    order = sorted(e[0] for e in entries)
    got = {r["tile"]: r["first_row"] for r in spmv.breakpoints(m, 16).collect()}
    assert got == {t: order[16 * t] for t in range(-(-len(order) // 16))}


def test_kernel_choice(spark):
    def choice(n, per_row, one=0):
        e = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("j")).union(spark.range(one).selectExpr("0L", "int(id)"))
        return spmv.kernel_choice(SparseMatrix(e.withColumn("v", F.lit(1.0)), n, n)).first()

    assert (choice(100, 2)["kernel"], choice(100, 2)["lanes"]) == ("line", 1)
    assert (choice(100, 10)["kernel"], choice(100, 10)["lanes"]) == ("line", 2)
    assert (choice(100, 129)["kernel"], choice(100, 129)["lanes"]) == ("flat", 4)


def test_compare(spark):
    y = lambda rows_: spark.createDataFrame(rows_, "i long, y double")
    a, b = y([(0, 1.0), (1, 100.0), (2, 5.0)]), y([(0, 1.005), (1, 100.9), (2, 6.0), (3, 0.001)])
    assert {r["i"]: r["ok"] for r in spmv.compare(a, b).collect()} == {0: True, 1: True, 2: False, 3: True}
    assert [tuple(r) for r in spmv.mismatches(a, b).collect()] == [(2, 5.0, 6.0)]


def test_blocks_and_grid(spark):
    for n in (1, 7, 8, 23):
        for parts in (1, 2, 3, 5):
            starts = scalars.block_starts(n, parts)
            got = {r["g"]: (r["owner"], r["lidx"]) for r in partition.assign_block(spark, n, parts).collect()}
            assert got == {g: (p, g - starts[p]) for p in range(parts) for g in range(starts[p], starts[p + 1])}
    assert [scalars.grid(p) for p in (1, 2, 3, 4, 6, 8, 12)] == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 4)]
    got = spark.range(1, 13).select("id", scalars.grid_rows(F.col("id")).alias("r")).collect()
    assert all(r["r"] == scalars.grid(r["id"])[0] for r in got)


def test_greedy_keeps_its_capacity(spark):
    """Against the sequential pass: loads within 1.1 of the mean, a cut of about the same size."""
    rnd, n, parts = random.Random(3), 600, 4
    e = [(u, (u + rnd.choice((1, 2, 5, 40))) % n, 1.0) for u in range(n) for _ in range(4)] + [(0, k, 1.0) for k in range(0, n, 7)]
    near, nnz = {k: set() for k in range(n)}, [0] * n
    for u, v, _ in e:
        nnz[u] += 1
        if u != v:
            near[u].add(v)
            near[v].add(u)
    capacity, owner, load = partition.SLACK * len(e) / parts, {}, [0] * parts
    for u in sorted(range(n), key=lambda u: (-len(near[u]), u)):
        count = [sum(owner.get(v) == p for v in near[u]) for p in range(parts)]
        owner[u] = max(range(parts), key=lambda p: (count[p] * (1 - load[p] / capacity), -load[p], -p))
        load[owner[u]] += nnz[u]
    m = SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), n, n)
    got = {r["g"]: r["owner"] for r in partition.assign_greedy(m, parts).collect()}
    loads = [sum(nnz[g] for g in got if got[g] == p) for p in range(parts)]
    assert max(loads) <= capacity
    cut = lambda where: sum(where[u] != where[v] for u, v, _ in e)
    assert cut(got) <= 1.1 * cut(owner)


def test_greedy_of_few_and_empty_rows(spark):
    for n, e in ((3, [(0, 1, 1.0)]), (5, []), (0, [])):
        a = partition.assign_greedy(SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), n, n), 4).collect()
        assert sorted(r["g"] for r in a) == list(range(n))


def test_ranked_within_groups(spark):
    rnd = random.Random(5)
    rows_ = [(rnd.choice(["a", "b", None]), rnd.randrange(1000), rnd.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows_, "k string, x int, w int")
    for weight in (None, F.col("w")):
        got = ranked(df, [F.col("x"), F.col("w")], "at", weight, by=("k",)).collect()
        for k in ("a", "b", None):
            mine = sorted((r["x"], r["w"], r["at"]) for r in got if r["k"] == k)
            upto = 0
            for _, w, at in mine:
                assert at == upto
                upto += 1 if weight is None else w
    assert ranked(df.limit(0), [F.col("x")], "at", by=("k",)).count() == 0


def test_components_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT", 5)
    monkeypatch.setattr(tables.hot_keys, "__defaults__", (5,))
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7), (50, 51), (51, 50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(100, 131), 100), 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_volumes_of_a_square_matrix_against_full_broadcast(spark):
    """The checkerboard moves x and y segments, one part its own whole vectors."""
    m = SparseMatrix(spark.createDataFrame([(k, (k * 7 + 3) % 36, 1.0) for k in range(36)], "i long, j long, v double"), 36, 36)
    rows = {r["P"]: r for r in partition.comm_volume(m, (1, 2, 3, 4)).collect()}
    assert [round(rows[p]["checkerboard_over_naive"], 6) for p in (1, 2, 3, 4)] == [2.0, 1.5, 1.333333, 1.0]
    assert {r["naive_bytes"] for r in rows.values()} == {144.0} and rows[1]["ghost_bytes"] == 0
