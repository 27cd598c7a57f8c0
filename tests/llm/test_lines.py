import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from meshwork.llm import lines as module
from meshwork.llm.lines import PerfectHash, dedup_lines

from .helpers import empty, table

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACE).encode().lower().decode()
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    shared = ["A line that many documents share, number %d of them" % k for k in range(6)] + ["é" * 40, "é" * 39, "short"]
    texts = []
    for _ in range(60):
        lines = [rnd.choice(shared) for _ in range(rnd.randint(0, 5))] + [str(rnd.random()) * 4]
        lines = [rnd.choice(["", "  ", "\t"]) + (x.upper() if rnd.random() < 0.3 and x.isascii() else x) + rnd.choice(["", " \r"]) for x in lines]
        rnd.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "x" * 200_000]
    df = table(spark, texts)
    got = sorted(tuple(r) for r in dedup_lines(df, digest=True).collect())
    assert got == brute(list(enumerate(texts)))
    kept = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert len(kept) == len(texts) and kept[0]["extra"] == "x"
    assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in kept.items()} == {r[0]: r[3] for r in got}


def test_edges(spark):
    assert dedup_lines(empty(spark), digest=True).count() == 0
    line = "the same line in each of these rows, again and again"
    # five documents (rows of one id are one, null is one), the last of which keeps its line
    same = table(spark, [line] * 7, ids=[1, 1, 2, 2, 3, None, 4])
    got = {(r["doc_id"], r["n_dropped"]) for r in dedup_lines(same, digest=True).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 0)}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash_is_minimal(keys):
    a, b = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    mph = PerfectHash.build(a, b)
    assert sorted(mph.slots(a, b).tolist()) == list(range(len(keys)))
    again = PerfectHash.unpack(*mph.pack())
    assert again.slots(a, b).tolist() == mph.slots(a, b).tolist()


def test_ids_of_other_types_and_clashing_columns(spark):
    line = "this is a line of many documents, long enough to count " * 2
    df = table(spark, [f"{k}\n{line}" for k in range(6)]).withColumns({c: F.lit(c) for c in ("a", "b", "n", "shard", "last_doc", "copies", "known", "hashes", "mean", "size", "target")})
    for kind in ("string", "int", "date"):
        ids = F.date_add(F.lit("2024-01-01"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
        rows = dedup_lines(df.withColumn("doc_id", ids)).orderBy("doc_id").collect()
        assert [r["n_dropped"] for r in rows] == [1] * 5 + [0] and all(r["hashes"] == "hashes" and r["shard"] == "shard" for r in rows)


def test_repeated_ids_and_any_columns(spark):
    """Rows of one id are one document when documents are counted."""
    line = "a line that is long enough to be a key of its own, " * 2
    three = table(spark, [line] * 5, ids=[1, 1, 1, 2, 2])
    assert {r["n_dropped"] for r in dedup_lines(three).collect()} == {0}
    five = table(spark, [f"{line}\nown {k}" for k in range(7)], ids=[1, 1, 2, 3, 4, 5, 5])
    assert sorted((r["doc_id"], r["n_dropped"]) for r in dedup_lines(five).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 0)]
    wide = five.withColumns({c: F.lit(f"{c}!") for c in ("__hashes", "hashes", "a.b", "__box", "d", "n_lines")})
    out = dedup_lines(wide)
    assert out.columns == [*(c for c in wide.columns if c not in ("text", "n_lines")), "text", "n_lines", "n_dropped"]
    assert out.filter("__hashes <> '__hashes!' OR `a.b` <> 'a.b!' OR __box <> '__box!' OR d <> 'd!'").isEmpty() and out.count() == 7


def test_shards_and_probes_meet_in_every_partition(spark, monkeypatch):
    """Many shards and copies, and partitions that Spark does not join into one."""
    monkeypatch.setattr(module, "SHARD_KEYS", 9)
    monkeypatch.setattr(module, "PROBES", 20)
    rnd = random.Random(4)
    shared = [f"line number {k} of those that some of the documents share" for k in range(30)]
    texts = ["\n".join([*rnd.sample(shared, rnd.randint(0, 9)), f"only here {k} " * 5, shared[0]]) for k in range(80)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in dedup_lines(table(spark, texts), digest=True).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(list(enumerate(texts)))
