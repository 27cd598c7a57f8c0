import inspect
import math
from collections import defaultdict

from pyspark.sql import functions as F

from meshwork.llm import mixing

from .helpers import babble, empty, table, words


def water(sizes):
    """Targets by rounds: cap, reshare by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target.update(share)
            break
        target.update({s: 3.0 * sizes[s] for s in above})
        open_ -= above
    return target


def corpus():
    import random

    rnd = random.Random(4)
    texts = [babble(rnd, rnd.randint(0, 60)) for _ in range(900)] + [None, "", "x " * 3000]
    sources = ["big"] * 6 + ["a", "b", "c", None, "tiny é"]
    return texts, sources


def test_targets_and_taken(spark):
    texts, sources = corpus()
    df = table(spark, texts, sources=sources)
    rows = mixing.plan(df).collect()
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]]))
        assert r["n_copies"] <= 3 and len(r["shards"]) == r["n_copies"]
        sizes[r["source"]] += r["size"]
    want, taken = water(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        taken[r["source"]] += r["size"] * r["n_copies"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]), s
    again = mixing.plan(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_has_each_copy(spark):
    texts, sources = corpus()
    df = table(spark, texts[:200], sources=sources)
    copies = mixing.plan(df).agg(F.sum("n_copies")).first()[0]
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == copies


def test_quotas_are_exact(spark):
    copies = spark.createDataFrame([("s%d" % (k % 5), False) for k in range(333)], "__s string, __n boolean")
    got = mixing._quotas(copies, 3).collect()
    by, shard = defaultdict(int), defaultdict(int)
    for r in got:
        by[r["__s"]] += r["q"]
        shard[r["shard"]] += r["q"]
    assert dict(by) == {f"s{k}": 333 // 5 + (k < 333 % 5) for k in range(5)}
    assert sum(shard.values()) == 333 and max(shard.values()) - min(shard.values()) <= 1


def test_edges(spark):
    assert mixing.plan(empty(spark)).count() == 0
    rows = mixing.plan(table(spark, [None, "", " "])).collect()
    assert {(r["size"], r["target"], r["n_copies"]) for r in rows} <= {(0, 0.0, k) for k in range(4)}


def test_native():
    code = inspect.getsource(mixing)
    assert not any(x in code for x in ("udf", "mapIn", "applyIn", "rdd", "toPandas", "collect()"))


def test_columns_that_clash(spark):
    names = ["rest", "target", "source_size", "whole", "size", "shards", "mean", "__block", "n_copies"]
    df = table(spark, ["a b c " * 30, "d e", None, "f g h i"] * 5).withColumns({c: F.lit(f"{c}!") for c in names})
    out = mixing.mix(df)
    assert out.columns == df.columns and out.filter(" OR ".join(f"`{c}` <> '{c}!'" for c in names)).isEmpty()
    plan = mixing.plan(df)
    assert plan.count() == 20 and plan.filter("mean <> 'mean!' OR rest <> 'rest!' OR whole <> 'whole!'").isEmpty()
    assert {f.name: f.dataType.simpleString() for f in plan.schema}["size"] == "bigint" and len(plan.columns) == len(set(plan.columns))
    ids = df.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert mixing.mix(ids).columns == df.columns


def test_many_copies_of_a_source(spark, monkeypatch):
    """Beyond URN copies the number is drawn at once; quotas stay exact."""
    monkeypatch.setattr(mixing, "URN", 20)
    copies = spark.createDataFrame([("a", False)] * 4000 + [("b", True)] * 900 + [("c", False)] * 7, "__s string, __n boolean")
    got = mixing._quotas(copies, 4).collect()
    by, shard, a = defaultdict(int), defaultdict(int), []
    for r in got:
        by[r["__s"]] += r["q"]
        shard[r["shard"]] += r["q"]
        a += [r["q"]] if r["__s"] == "a" else []
    assert dict(by) == {"a": 4000, "b": 900, "c": 7}
    assert max(shard.values()) - min(shard.values()) <= 1 and all(q > 0 for q in by.values())
    # 250 a shard, with a deviation of about 6.3
    assert len(a) == 16 and all(abs(q - 250) < 40 for q in a) and len(set(a)) > 4


def test_very_long_text(spark):
    rows = mixing.plan(table(spark, ["w " * 2_000_000, "a b", "c d e"], sources=["a", "b", "b"])).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {0: 2_000_000, 1: 2, 2: 3}


def test_draws_follow_the_law(spark):
    """The ratio of uniforms against the hypergeometric weights (chi square)."""
    n = 20_000
    for q, left, room in ((30, 40, 100), (60, 40, 100), (30, 70, 100), (70, 65, 100), (7, 50, 100)):
        drawn = lambda *x: F.pmod(F.xxhash64("id", *(F.lit(k) if isinstance(k, str) else k for k in x)), F.lit(1 << 30)) / float(1 << 30)
        got = spark.range(n).select(mixing._many(F.lit(q), F.lit(left), F.lit(room), drawn).alias("z")).groupBy("z").count().collect()
        seen = {r["z"]: r["count"] for r in got}
        law = {z: n * math.comb(left, z) * math.comb(room - left, q - z) / math.comb(room, q) for z in range(max(0, q + left - room), min(q, left) + 1)}
        assert set(seen) <= set(law) and sum(seen.values()) == n
        often = [z for z, e in law.items() if e >= 10]
        chi = sum((seen.get(z, 0) - law[z]) ** 2 / law[z] for z in often)
        assert chi < len(often) + 5 * math.sqrt(2 * len(often)), (q, left, room, chi)


def test_many_shards(spark):
    """2 ** 16 shards: their quotas come from several tasks and stay exact."""
    copies = spark.range(200_000).selectExpr("concat('s', id % 3) AS __s", "id % 7 = 0 AS __n")
    quotas = mixing.written(mixing._quotas(copies, 16), "quotas")
    assert len(quotas.inputFiles()) > 1
    sums = quotas.groupBy("shard").agg(F.sum("q").alias("q")).agg(F.count("*").alias("n"), F.min("q").alias("least"), F.max("q").alias("most")).first()
    assert tuple(sums) == (1 << 16, 3, 4)
    want = {(r["__s"], r["__n"]): r["count"] for r in copies.groupBy("__s", "__n").count().collect()}
    assert {(r["__s"], r["__n"]): r["q"] for r in quotas.groupBy("__s", "__n").agg(F.sum("q").alias("q")).collect()} == want
