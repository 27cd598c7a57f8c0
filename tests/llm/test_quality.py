import random
import re
from collections import Counter

from pyspark.sql import functions as F

from meshwork.llm import quality

from .helpers import WORD, babble, empty, table


def brute(text):
    w = WORD.findall(text or "")
    seen, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            repeated |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def corpus():
    rnd = random.Random(5)
    clean = [babble(rnd, rnd.randint(60, 400), 3000) + "\n" + babble(rnd, 30, 3000) for _ in range(300)]
    junk = [" ".join(x + rnd.choice(["***", "$$$", "|"]) for x in babble(rnd, 120, 3000).split()) for _ in range(15)]
    odd = [None, "", "one", "é à\n\né à\n \x0bé à\r", "same words here " * 60, "x " * 100_000]
    return clean, junk, odd


def test_counts_and_verdicts(spark):
    clean, junk, odd = corpus()
    texts = clean + junk + odd
    got = {r["doc_id"]: r for r in quality.judge(table(spark, texts, sources=["a", "a", "b", None])).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert tuple(got[k][c] for c in quality.COUNTS) == brute(text)
        n, rep = got[k]["n_words"], got[k]["n_repeat_words"]
        assert got[k]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[k]["base_failed"] and got[k]["kept"])
    assert all(got[k]["kept"] for k in range(len(clean)))
    assert not any(got[k]["kept"] for k in range(len(clean), len(clean) + len(junk)))


def test_edges(spark):
    assert quality.judge(empty(spark)).count() == 0
    # copies of one document: no variance, nothing to reject
    same = table(spark, [babble(random.Random(1), 80)] * 150, sources=["a"])
    assert quality.keep(same).count() == 150 and quality.keep(same).columns == same.columns
    few = table(spark, [babble(random.Random(k), 80) for k in range(5)])
    assert quality.keep(few).count() == 5


def test_columns_that_clash(spark):
    rnd = random.Random(8)
    df = table(spark, [babble(rnd, 80) for _ in range(60)] + [None, "short"], langs=["en", None])
    names = ["mean", "inverse", "g", "n", "cov", "size", "target", "cell", "__lines2"]
    wide = df.withColumns({c: F.lit(f"{c}!") for c in names})
    kept = quality.keep(wide)
    assert kept.columns == wide.columns and kept.filter(" OR ".join(f"`{c}` <> '{c}!'" for c in names)).isEmpty()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.keep(df).collect()}
    ids = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert quality.keep(ids).count() == kept.count()


def test_columns_of_any_name(spark):
    df = table(spark, [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(12)])
    names = ("__lines", "__lang", "__key", "__group", "__one", "__box", "a.b", "kept", "n_words", "g", "c")
    wide = df.withColumns({c: F.lit(f"{c}!") for c in names})
    out = quality.keep(wide)
    assert out.columns == wide.columns and out.count() == 12
    assert out.filter(" OR ".join(f"`{c}` <> '{c}!'" for c in names)).isEmpty()
    judged = quality.judge(wide)
    assert judged.columns == [*(c for c in wide.columns if c not in quality.MADE), *quality.MADE] and judged.filter("__lines <> '__lines!' OR `a.b` <> 'a.b!'").isEmpty()
