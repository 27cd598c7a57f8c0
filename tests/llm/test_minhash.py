import random

import numpy as np

from pyspark.sql import functions as F

from meshwork.llm import minhash

from .helpers import babble, empty, table, words


def brute(texts, k=2, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [top(x) for x in range(len(sets))]


def corpus(rnd, groups=12):
    texts = []
    for _ in range(groups):
        base = babble(rnd, rnd.randint(40, 150), 3000).split()
        for _ in range(rnd.randint(1, 14)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(own) if rnd.random() < 0.7 else "\t".join(x.upper() for x in own))
    return texts + [None, "", " \n", "one", "ONE", "two words", "é É"]


def test_components(spark, monkeypatch):
    rnd = random.Random(11)
    for k in (2, 5):
        for small, block in ((64, 256), (3, 4)):
            monkeypatch.setattr(minhash, "SMALL", small)
            monkeypatch.setattr(minhash, "BLOCK", block)
            texts = corpus(rnd)
            sizes, roots = brute(texts, k)
            got = {r["doc_id"]: r for r in minhash.near_groups(table(spark, texts), k).collect()}
            assert len(got) == len(texts)
            assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
            assert [got[i]["component_id"] for i in range(len(texts))] == roots
            assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_dedup_keeps_one_of_each(spark):
    texts = corpus(random.Random(2), 5)
    df = table(spark, texts)
    _, roots = brute(texts, 5)
    left = minhash.dedup(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(roots)


def test_dedup_of_null_and_equal_ids(spark):
    rnd = random.Random(8)
    clean = [babble(rnd, 60, 3000) for _ in range(12)]
    near = clean[0].split()
    near[-1] = "changed"
    texts = [*clean[:5], " ".join(near), clean[5], clean[6], clean[5], clean[7], clean[7], None, "", clean[0]]
    ids = [None, None, None, None, None, None, 1, 1, 0, 2, 2, None, None, None]
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.dedup(table(spark, texts, ids=ids)).collect()), key=str)
    # of the near copies without an id either may stay
    first = [x for x in left if x[1] in (clean[0], " ".join(near))]
    assert len(first) == 1
    want = [*((None, x) for x in (*clean[1:5], None, "")), (1, clean[6]), (0, clean[5]), (2, clean[7])]
    assert sorted(x for x in map(str, left) if x != str(first[0])) == sorted(map(str, want))


def test_edges(spark):
    assert minhash.near_groups(empty(spark)).count() == 0
    rows = minhash.near_groups(table(spark, ["a b c"] * 40 + ["q r s"], ids=[*range(38), 0, None, 99])).collect()
    assert len(rows) == 41 and {r["component_id"] for r in rows} == {0, 99}
    assert minhash.near_groups(table(spark, [None, "", " "])).filter("kept").count() == 3


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    got = minhash._overlaps(sets[:4], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:4]]


def test_recall_of_tables():
    """Two sets of similarity 0.8 meet unless fewer than two collections agree."""
    p = 0.8**minhash.WIDTH
    n = minhash.COLLECTIONS
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) < 5e-4


def test_columns_of_any_name(spark):
    df = table(spark, [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(12)])
    names = ("__lines", "__lang", "__key", "__group", "__one", "__box", "a.b", "kept", "n_words", "g", "c")
    wide = df.withColumns({c: F.lit(f"{c}!") for c in names})
    out = minhash.dedup(wide)
    assert out.columns == wide.columns and out.count() == 12
    assert out.filter(" OR ".join(f"`{c}` <> '{c}!'" for c in names)).isEmpty()
