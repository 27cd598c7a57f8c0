"""Manifests against trees built by hand, and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from meshwork.llm import merkle

from .helpers import empty, lowered, table


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def _tree(nodes):
    """Root, and for each node its siblings and places level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((p % 8, [d for x, d in enumerate(run) if x != p % 8]))
            at[k] = p // 8
        level = [_h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for lang in langs:
        own = sorted(((r["doc_id"], _leaf(r["doc_id"], r["text"], lang, r["source"], r["n_chars"]), r) for r in by[lang]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs.append((own, *_tree([d for _, d, _ in own])))
    root, upper = _tree([s[1] for s in subs])
    out = []
    for (own, sub, paths), above in zip(subs, upper, strict=True):
        for (doc_id, leaf, r), path in zip(own, paths, strict=True):
            path, cur = [*path, *above], leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r["text"] is not None:
                cur = _leaf(doc_id, lowered(r["text"]), r["lang"], r["source"], r["n_chars"])
            for place, siblings in path:
                cur = _h(*siblings[:place], cur, *siblings[place:])
            out.append((doc_id, leaf, sub, root, _h(*(d for _, s in path for d in s)), cur, cur == root))
    return sorted(out, key=str)


def got(df):
    out = merkle.verified(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, ["en", None]), (700, ["en"]), (1300, ["en"] * 600 + ["é", "zz", None])])
def test_equals_trees_built_by_hand(spark, n, langs):
    df = table(spark, [f"Text {k} É" if k % 5 else None for k in range(n)], langs=langs)
    assert got(df) == brute(df.collect())


def test_many_languages_make_several_levels(spark):
    df = table(spark, [f"T{k}" for k in range(1200)], langs=[f"l{k % 600}" for k in range(600)])
    assert got(df) == brute(df.collect())


def test_nulls_ties_and_repeated_rows(spark):
    df = table(spark, ["a", "a", None, "B", "B", ""] * 4, ids=[1, 1, 1, None, None, 7] * 4, langs=[None])
    rows = got(df)
    assert rows == brute(df.collect()) and len(rows) == 24


def test_proofs_fold_to_the_root(spark):
    df = table(spark, [f"t{k}" for k in range(100)], langs=["en", "de", "fr"])
    for r in merkle.manifest(df).collect():
        assert merkle.folded(bytes.fromhex(r["leaf"]), bytes(r["proof"]), bytes(r["shape"])).hex() == r["root"]


def test_empty_table_and_clashing_columns(spark):
    assert got(empty(spark)) == []
    df = table(spark, [f"x{k}" for k in range(20)])
    more = df.withColumns({c: F.lit(1) for c in ("tree", "place", "n", "digest", "leaf", "root", "a.b", "__w", "__part")})
    assert got(more) == got(df)


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(merkle.OP13_SQL).fetchall()
    have = [tuple(r) for r in merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(have) == sorted(want)
