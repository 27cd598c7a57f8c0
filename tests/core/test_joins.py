"""As-of and range joins against loops; sketches against exact ranks."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.jobs import sketches
from meshwork.operators.ranges import range_join
from meshwork.operators.temporal import asof_join
from tests.core.helpers import shuffled_rows


@pytest.mark.parametrize("by", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, by, strict):
    rnd = random.Random(3)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    left = [(k, key(), rnd.choice([None, *range(0, 60)])) for k in range(300)]
    right = [(k, key(), rnd.choice([None, *range(10, 50, 2)])) for k in range(120)]
    a = spark.createDataFrame(left, "id long, k int, t int").repartition(5)
    b = spark.createDataFrame(right, "event long, user int, ts int").repartition(3)
    got = asof_join(a, b, "t", "ts", by=(("k", "user"),) if by else (), tie="event", strict=strict).collect()
    want = {}
    for k, user, t in left:
        able = [(ts, e) for e, u, ts in right if t is not None and ts is not None and (ts < t if strict else ts <= t) and (not by or u == user)]
        want[k] = max(able)[1] if able else None
    assert len(got) == 300 and {r["id"]: r["matched"]["event"] if r["matched"] else None for r in got} == want


def test_asof_edges(spark):
    a = spark.createDataFrame([(1, 5)], "id long, t int")
    none = spark.createDataFrame([], "ts int, v string")
    assert [r["matched"] for r in asof_join(a, none, "t", "ts").collect()] == [None]
    assert asof_join(a.limit(0), none, "t", "ts").count() == 0
    wide = a.withColumns({"a.b": F.lit(1), "__t": F.lit(2)})
    assert asof_join(wide, none, "t", "ts").columns == ["id", "t", "a.b", "__t", "matched"]


@pytest.mark.parametrize("hot", [4, 10**6])
def test_range_join(spark, hot):
    rnd = random.Random(9)
    points = [(k, rnd.choice([None, 5.0, rnd.uniform(-20, 120)])) for k in range(300)]
    spans = [(k, lo, rnd.choice([None, lo, lo + rnd.choice([0.5, 1, 3, 90, 1000])])) for k in range(120) for lo in [rnd.uniform(-30, 100)]]
    p, s = spark.createDataFrame(points, "id long, x double").repartition(4), spark.createDataFrame(spans, "span long, lo double, hi double").repartition(3)
    got = sorted((r["id"], r["span"]) for r in range_join(p, s, "x", "lo", "hi", hot).collect())
    assert got == sorted((k, j) for k, x in points for j, lo, hi in spans if x is not None and hi is not None and lo <= x < hi)
    joined = range_join(p, s, "x", "lo", "hi")
    plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        range_join(p, s.withColumnRenamed("span", "id"), "x", "lo", "hi")
    assert range_join(p.limit(0), s, "x", "lo", "hi").count() == 0 and range_join(p, s.limit(0), "x", "lo", "hi").count() == 0


def test_range_join_shuffles_a_point_once(spark):
    rnd = random.Random(12)
    points = [(k, rnd.uniform(0, 400)) for k in range(3000)]
    spans = [(k, lo, lo + rnd.choice([0.5, 4, 20, 150])) for k in range(150) for lo in [rnd.uniform(0, 300)]]
    p, s = spark.createDataFrame(points, "id long, x double").repartition(4), spark.createDataFrame(spans, "span long, lo double, hi double").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p, s = p.localCheckpoint(), s.localCheckpoint()
        before = shuffled_rows(spark)
        n = range_join(p, s, "x", "lo", "hi").count()
        assert n == sum(lo <= x < hi for _, x in points for _, lo, hi in spans) and shuffled_rows(spark) - before < 1.5 * len(points)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["long", "decimal(38,2)", "double"])
@pytest.mark.parametrize("hot", [7, 10**6])
def test_range_join_hot_on_both_sides(spark, kind, hot, monkeypatch):
    """One value and one interval many times, numbers that doubles don't tell
    apart, cells in pieces on both sides."""
    monkeypatch.setattr("meshwork.operators.ranges.PAIRS", 50)
    rnd = random.Random(13)
    far = 0 if kind == "double" else 1 << 60
    points = [(k, rnd.choice([far + 10, far + 10, far + rnd.randrange(60), rnd.randrange(-50, 50)])) for k in range(200)]
    spans = [(k, lo, lo + rnd.choice([1, 2, 30])) for k in range(120) for lo in [rnd.choice([far + 10, far + rnd.randrange(-5, 60), rnd.randrange(-60, 50)])]]
    p, s = spark.createDataFrame(points, "id long, x long").withColumn("x", F.col("x").cast(kind)), spark.createDataFrame(spans, "span long, lo long, hi long").withColumns({c: F.col(c).cast(kind) for c in ("lo", "hi")})
    got = sorted((r["id"], r["span"]) for r in range_join(p.repartition(3), s.repartition(2), "x", "lo", "hi", hot).collect())
    assert got == sorted((k, j) for k, x in points for j, lo, hi in spans if lo <= x < hi)


def test_sketches_merge_like_the_records(spark):
    rnd = random.Random(2)
    rows = [(f"m{rnd.randrange(4)}", rnd.choice(["bcast", "ghost"]), "acc", rnd.choice([1, 2, 4]), rnd.lognormvariate(2, 1)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "matrix string, comm string, kernel string, P int, total_avg_ms double")
    parts = df.randomSplit([1.0, 1.0, 1.0], seed=4)
    got = {tuple(r[:4]): r for r in sketches.cube(sketches.merged([sketches.summarised(p) for p in parts])).collect()}
    for key in ((None, None, None, None), ("m1", None, None, None), (None, "bcast", None, 2), ("m0", "ghost", "acc", 4)):
        mine = sorted(r[4] for r in rows if all(k is None or k == v for k, v in zip(key, r, strict=False)))
        r = got[key]
        assert r["n"] == len(mine) and abs(r["average"] - sum(mine) / len(mine)) < 1e-9 and (r["least"], r["greatest"]) == (mine[0], mine[-1])
        for p, c in ((0.5, "median"), (0.95, "p95")):
            rank = sum(x <= r[c] for x in mine) / len(mine)
            assert abs(rank - p) < 0.03, (key, c, rank)
        assert r["n_matrices"] == len({x[0] for x in rows if all(k is None or k == v for k, v in zip(key, x, strict=False))})
