import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from meshwork.llm import suffix

from .helpers import empty, table


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + 200] for x in data for k in range(len(x) - 199))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def corpus(rnd):
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(1000)) for _ in range(6)]
    texts = []
    for _ in range(90):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            a, n = rnd.randint(0, 900), rnd.choice([10, 100, 150, 190, 199, 200, 201, 210, 230, 300, 400])
            t += rnd.choice(base)[a : a + n] + "".join(rnd.choice("xyz ") for _ in range(rnd.choice([0, 1, 5, 60])))
        texts.append(t)
    return [*texts, None, "", "ab" * 400, "a" * 450, "a" * 199, "a" * 200, texts[0], texts[1]]


def test_matches_brute_force(spark, monkeypatch):
    for seed, shard in ((1, suffix.SHARD), (2, 3000)):
        monkeypatch.setattr(suffix, "SHARD", shard)
        texts = corpus(random.Random(seed))
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix.dedup_substrings(table(spark, texts)).collect()}
        assert [got[k] for k in range(len(texts))] == brute(texts)


def test_sql_matches_brute_force():
    texts = [*corpus(random.Random(3)), "".join(chr(97 + k * k % 23 + k % 3) for k in range(2500)), "q" * 2300]
    documents = pa.table({"doc_id": range(len(texts)), "text": texts})
    with duckdb.connect() as con:
        con.register("documents", documents)
        assert [r[1:] for r in sorted(con.execute(suffix.OP6_SQL).fetchall())] == brute(texts)


def test_edges(spark):
    assert suffix.dedup_substrings(empty(spark)).count() == 0
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = suffix.dedup_substrings(table(spark, [text, text, text, text + "!"], ids=[1, 1, 2, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [260, 260, 260, 260]


def test_family_finds_every_repeat():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 4000, 5000).astype(np.uint64)
    index = suffix.Family(len(prints))
    for at in range(0, len(prints), 300):
        index.add(prints[at : at + 300], at)
    counts = Counter(prints.tolist())
    assert [v > 0 for v in index.verdict] == [counts[x] > 1 for x in prints.tolist()]
    shown = Counter(prints[index.verdict == suffix.SHOWN].tolist())
    assert set(shown) == {x for x, n in counts.items() if n > 1} and len(index.levels) <= 6
