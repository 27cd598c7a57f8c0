import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meshwork.llm import lm

from .helpers import empty, table, words


def corpus(n=400):
    """Two languages whose words do not mix, so that the context tells."""
    rnd = random.Random(6)
    texts = []
    for k in range(n):
        mine = [f"{'ab'[k % 2]}{j}" for j in range(150)]
        texts.append(" ".join(rnd.choice(mine[: rnd.choice([10, 40, 150])]) for _ in range(rnd.randint(20, 120))))
    return [*texts, None, "", "  ", "rare-%d" % rnd.random()]


def training():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1


def test_base_and_gain(spark):
    texts = corpus(3000)
    got = {r["doc_id"]: r for r in lm.score(table(spark, texts), training()).collect()}
    counts = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    base = score = 0
    for k, t in enumerate(texts):
        w, r = [*words(t), None], got[k]
        want = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, -want)
        if r["held_out"]:
            base, score = base + want, score + r["score"]
    assert score > base


def _held_out(df):
    r = lm.score(df, training()).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    return r["s"] / r["n"], r["b"] / r["n"]


def test_scores_do_not_depend_on_the_splits(spark):
    df = table(spark, corpus(1500))
    got = [_held_out(df.repartition(n)) for n in (1, 8, 64)]
    assert max(s for s, _ in got) - min(s for s, _ in got) < 0.001 and all(s < 0 and s > b for s, b in got)


def test_many_trainers_keep_the_gain(spark, monkeypatch):
    """As many trainers and rounds as a large corpus has, on a small one."""
    df = table(spark, corpus(3000))
    monkeypatch.setattr(lm, "PARAMETER_TOKENS", 0)
    gains = []
    for share, fan in ((10**9, 64), (15_000, 64), (1500, 4)):
        monkeypatch.setattr(lm, "TRAINER_TOKENS", share)
        monkeypatch.setattr(lm, "FAN", fan)  # several levels of the tree
        score, base = _held_out(df)
        gains.append(score - base)
    one, few, many = gains
    assert one > 0 and few > 0.7 * one and many > 0.5 * one, gains


def test_schedule():
    assert lm.schedule(0, 100) == (1, 1) and lm.schedule(2_000_001, 100) == (2, 1)
    for n, p in ((10**8, 230_000), (5 * 10**9, 1_200_000), (16 * 10**12, 43_000_000)):
        rounds, trainers = lm.schedule(n, p)
        assert rounds == lm.ROUNDS and n / (rounds * trainers) <= max(lm.TRAINER_TOKENS, lm.PARAMETER_TOKENS * p)


def test_one_trainer_keeps_its_steps(spark):
    """A parameter that one trainer alone has moved keeps its step; one that
    two have moved alike keeps it too."""
    layout = lm.Layout(4)
    m = lm.Model(np.zeros(lm.Model.size(layout), np.float32), layout)
    past, n = np.ones(len(m.flat), np.float32), len(m.flat)
    rows = []
    for k, (step, weight) in enumerate(((1.0, 2.0), (1.0, 2.0), (0.0, 0.0))):
        steps, weights = np.full(n, step, np.float32), np.full(n, weight, np.float32)
        if k == 1:
            weights[0] = 0
        rows.append((k, 0, (steps * weights).tobytes(), weights.tobytes(), (weights * weights).tobytes()))
    flat, after = lm._averaged(spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], lm._SUMS), 3, m, past)
    assert np.allclose(flat, 1) and np.allclose(after, 3)


def test_rare_words_ask_the_shards(spark, monkeypatch):
    texts = corpus(60)
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(table(spark, texts), training()).collect()}
    monkeypatch.setattr(lm, "TOP", 20)
    monkeypatch.setattr(lm, "SHARD_BYTES", 5000)
    monkeypatch.setattr(lm, "SHARD_ASKS", 100)
    few = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(table(spark, texts), training()).collect()}
    assert few == whole


def test_normalised():
    rng = np.random.default_rng(3)
    for layout in (lm.Layout.of(0), lm.Layout.of(200_000_000)):
        unigram = rng.random(layout.items)
        m = lm.Model.start(unigram / unigram.sum(), layout)
        m.word[:] = rng.normal(0, 1, m.word.shape)
        m.group[:] = rng.normal(0, 1, m.group.shape)
        one = rng.integers(0, layout.items, (lm.CONTEXT, 1)).astype(np.int32)
        every = np.arange(layout.items).astype(np.int32)
        p = np.exp(m.scores(np.repeat(one, len(every), axis=1), every))
        assert abs(p.sum() - 1) < 1e-4
    assert lm.Layout.of(0).words == lm.FEWEST and 8000 < lm.Layout.of(200_000_000).words < 8300 and lm.Layout.of(10**12).words > 300_000


def test_words_of_an_ending_share_its_probability(spark):
    """All words, items or not, and one that nobody has seen add up to one."""
    texts = ["a b c d e f g", "h1 h2 h3 zz yz"]
    got = [r["score"] for r in lm.score(table(spark, [*texts, *(f"q{k}" for k in range(5))]), F.col("doc_id") < 2).collect()]
    assert all(math.isfinite(x) and x < 0 for x in got)


def test_edges(spark):
    assert lm.score(empty(spark), training()).count() == 0
    rows = lm.score(table(spark, ["a b", "a b"], ids=[1, 1]), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"]) for r in rows)
