"""MinHash near-dedup with tensored banding.

Method: ``COLLECTIONS`` small collections of ``WIDTH`` minhashes each; the key
of a table is a pair of collections.  So 20 x 4 = 80 minhashes make 190 tables
of 8-minhash keys, for which plain banding of the same recall needs over 300
minhashes.  Two sets of similarity 0.8 meet in a table unless fewer than two
collections agree: 4 in 10,000; at 0.85, 1 in 100,000.

Equal shingle sets are one class, named by its smallest doc_id.  A collection's
value that only one class has can make no candidate; so tables are formed only
from values that two classes share.  Buckets are not turned into pairs: each
links its members to its first, and what such links reach is a cluster, whose
documents make their full sets.  Ten tables without a collection in common come
first; what they connect enters the others as one.  Within clusters similarity is computed exactly
on these, by an inverted index over blocks of members: all pairs of a small
cluster; in a large one all members against the one that shares most buckets,
then those that are not similar to it against all.  Tasks return the links of a
spanning forest, never more than they have members.

Null or empty texts and texts without words have the empty set and link with
nothing.  Repeated rows are copies of each other; to ``near_groups`` rows that
share an id are one document wherever that id names its class, ``dedup`` tells
rows apart by id and text.  An empty table gives an empty result.  Other columns
are carried by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER, UPPER, boxed, column, lean, load, mix64, pieces, unboxed, word_hashes, written

WIDTH, COLLECTIONS = 4, 20
PERCENT = 80
SMALL, PACK, BLOCK = 64, 512, 256  # members of a small cluster, of a pack of such, of a block of a large one
BROADCAST_IDS = 2_000_000  # 16 MB

_rng = np.random.Generator(np.random.PCG64(77001))
_FLIP = _rng.integers(0, 1 << 63, WIDTH * COLLECTIONS, dtype=np.uint64) * np.uint64(2)
_TIMES = _rng.integers(0, 1 << 63, WIDTH * COLLECTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(hashes: np.ndarray, words: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted set of k-word shingle hashes of each row; all words as one
    shingle if there are fewer."""
    n = len(hashes)
    if n >= k:
        every = hashes[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            every = every + hashes[j : n - k + 1 + j] * _STEP[j]
        every = mix64(every)
    out, at = [], 0
    for count in words.tolist():
        if count >= k:
            s = np.sort(every[at : at + count - k + 1])
        elif count:
            s = mix64(np.sum(hashes[at : at + count] * np.array(_STEP[:count]), keepdims=True) + np.uint64(count))
        else:
            s = np.zeros(0, np.uint64)
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        at += count
    return out


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (s1, s2; null if it is
    empty) and the collections' values (c)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offs in pieces(column(batch, "text")):
                _, _, words, hashes = word_hashes(data, offs)
                sets = shingle_sets(hashes, words, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                values = np.zeros((len(full), COLLECTIONS), np.uint64)
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    x = np.concatenate([sets[r] for r in full])
                    begin = np.cumsum(sizes[full]) - sizes[full]
                    s1[full] = mix64(np.add.reduceat(mix64(x ^ _STEP[1]), begin))
                    s2[full] = mix64(np.add.reduceat(mix64(x ^ _STEP[2]), begin) + sizes[full].astype(np.uint64))
                    for c in range(COLLECTIONS):
                        for m in range(c * WIDTH, c * WIDTH + WIDTH):
                            values[:, c] = values[:, c] * _STEP[3] + np.minimum.reduceat((x ^ _FLIP[m]) * _TIMES[m], begin)
                    values = mix64(values)
                empty = sizes == 0
                place = np.concatenate([[0], np.cumsum(np.where(empty, 0, COLLECTIONS))]).astype(np.int32)
                c = pa.ListArray.from_arrays(pa.array(place), pa.array(values.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(start, end - start), pa.array(sizes), pa.array(s1.view(np.int64), mask=empty), pa.array(s2.view(np.int64), mask=empty), c], names=["doc_id", "n_shingles", "s1", "s2", "c"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, c array<long>")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offs in pieces(column(batch, "text")):
                _, _, words, hashes = word_hashes(data, offs)
                sets = [s.tobytes() for s in shingle_sets(hashes, words, k)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(start, end - start), pa.array(sets, pa.binary())], names=["doc_id", "members"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, members binary")


def _collections(classes: DataFrame) -> DataFrame:
    """node and vs: a node's values (j, v) that another class shares."""
    single = classes.select("node", F.posexplode("c").alias("j", "v"))
    shared = single.groupBy("j", "v").agg(F.count("*").alias("n")).filter("n > 1").select("j", "v")
    left = single.join(shared, ["j", "v"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("vs"))
    return left.filter(F.size("vs") > 1)


def _tables(left: DataFrame, first: bool) -> DataFrame:
    """node and key of every table entry: of the ``COLLECTIONS`` / 2 tables
    whose pairs have no collection in common, or of all others."""
    pairs = F.flatten(F.transform("vs", lambda x, i: F.transform(F.slice("vs", i + 2, F.lit(COLLECTIONS)), lambda y: F.struct(((x["j"] % 2 == 0) & (y["j"] == x["j"] + 1)).alias("first"), F.xxhash64(x["j"], x["v"], y["j"], y["v"]).alias("key")))))
    return left.select("node", F.inline(pairs)).filter(F.col("first") if first else ~F.col("first")).select("node", "key")


def _met(entries: DataFrame) -> DataFrame:
    """leader (the least of a bucket) and node, of buckets with several nodes."""
    keys = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    # of buckets with the same members one is enough
    keys = keys.groupBy("n", "leader", "members").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    return entries.join(keys.select("key", "leader", "n", "times"), "key").groupBy("leader", "node").agg(F.sum(F.col("n") * F.col("times")).alias("hits"))


def _reached(met: DataFrame) -> DataFrame:
    """node and label of what such links connect."""
    # a node's leaders reach each other through the least of them: nodes share such links of leaders
    first = met.select("leader", "node", F.min("leader").over(W.partitionBy("node")).alias("a"))
    return components(first.select("a", F.col("node").alias("b")).union(first.select("a", F.col("leader").alias("b"))).distinct())


def _clusters(classes: DataFrame) -> DataFrame:
    """node, c and hits: classes that share buckets, by the smallest node that
    such links reach, and how many companions a node meets in its buckets.

    Near copies meet in nearly all tables.  So the few tables that have no
    collection in common come first; what they connect enters the other tables
    as one, once for each of its keys, and only keys of several such groups link."""
    left = written(_collections(classes), "near-collections")
    met = written(_met(written(_tables(left, first=True), "near-buckets")), "near-met")
    early = written(_reached(met), "near-early")
    named = left.join(early, "node", "left").select(F.coalesce("label", "node").alias("node"), "vs")
    others = _tables(named, first=False).distinct()
    links = written(_met(written(others, "near-buckets")), "near-met")
    late = _reached(links).withColumnRenamed("node", "early").withColumnRenamed("label", "late")
    # every node that meets another, in the first tables or by its group in the others
    nodes = left.select("node").join(early, "node", "left").withColumn("early", F.coalesce("label", "node"))
    nodes = nodes.join(late, "early", "left").filter("label IS NOT NULL OR late IS NOT NULL")
    hits = met.groupBy("node").agg(F.sum("hits").alias("hits"))
    return nodes.join(hits, "node", "left").select("node", F.coalesce("late", "early").alias("c"), F.coalesce("hits", F.lit(0)).alias("hits"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by an
    inverted index of the right ones."""
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for k, x in enumerate(left):
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        if n.any():
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[k] = np.bincount(owner[at], minlength=len(right))
    return out


def _forest(left: list, right: list, left_sets: list[np.ndarray], right_sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links that connect what all similar pairs of left and right connect."""
    common = _overlaps(left_sets, right_sets)
    sizes = np.array([len(x) for x in left_sets])[:, None] + np.array([len(x) for x in right_sets])[None, :]
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x] = root.get(root[x], root[x])
        return x

    links = []
    for i, j in zip(*np.nonzero(100 * common >= percent * (sizes - common)), strict=True):
        a, b = top(left[i]), top(right[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((left[i], right[j]))
    return links


def _links(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) within clusters, from (c, node, size, members):
    enough of them to connect what all similar pairs of a cluster connect.

    Small clusters are packed, and all their pairs compared.  Of a large one the
    member that meets most others is compared with all; those that are not
    similar to it are compared with all, block by block."""
    kind = members.schema["node"].dataType
    link = f"a {kind.simpleString()}, b {kind.simpleString()}"
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())]) if kind.simpleString() == "bigint" else None

    def table(links: list[tuple]) -> pa.Table:
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": list(a), "b": list(b)}, schema=arrow) if arrow or links else pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})

    def sets(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x.as_py(), np.uint64) for x in t.column("members")]

    def pack(t: pa.Table) -> pa.Table:
        by: dict = {}
        nodes, every = t.column("node").to_pylist(), sets(t)
        for k, c in enumerate(t.column("c").to_pylist()):
            by.setdefault(c, []).append(k)
        links = []
        for rows in by.values():
            own, mine = [nodes[k] for k in rows], [every[k] for k in rows]
            links += _forest(own, own, mine, mine, percent)
        return table(links)

    small = members.filter(F.col("size") <= SMALL)
    n = small.count()
    packs = max(1, n // PACK)
    out = small.withColumn("pack", F.pmod(F.xxhash64("c"), F.lit(packs))).groupBy("pack").applyInArrow(pack, link)
    large = members.filter(F.col("size") > SMALL)
    if large.isEmpty():
        return out

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table([])
        return table(_forest(left.column("node").to_pylist(), right.column("node").to_pylist(), sets(left), sets(right), percent))

    def compared(some: DataFrame) -> DataFrame:
        """Links of some members of large clusters (with ``some``, how many
        there are in the cluster) with all members, in blocks of both."""
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        left = some.withColumn("lb", F.pmod(F.xxhash64("node"), blocks("some"))).withColumn("rb", every("size"))
        counts = some.groupBy("c").agg(F.first("some").alias("some"))
        right = large.join(counts, "c").withColumn("rb", F.pmod(F.xxhash64("node"), blocks("size")).cast("int")).withColumn("lb", every("some"))
        cells = ["c", "lb", "rb"]
        # both come from the same table: columns of their own for each
        own = lambda d: d.select(*(F.col(x).cast("int").alias(x) if x in ("lb", "rb") else F.col(x).alias(x) for x in (*cells, "node", "members")))
        return own(left).groupBy(*cells).cogroup(own(right).groupBy(*cells)).applyInArrow(cell, link)

    heads = large.groupBy("c").agg(F.max_by("node", F.struct("hits", "node")).alias("node"))
    star = written(compared(large.join(heads, ["c", "node"]).withColumn("some", F.lit(1))), "near-star")
    linked = star.select(F.col("a").alias("node")).union(star.select("b")).union(heads.select("node")).distinct()
    rest = large.join(linked, "node", "left_anti")
    rest = written(rest.join(rest.groupBy("c").agg(F.count("*").alias("some")), "c"), "near-rest")
    return out.union(star).union(compared(rest))


def near_groups(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = written(_sketches(docs, k), "near-sketches")
    classes = written(rows.filter(F.col("s1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("c").alias("c")), "near-classes")
    clusters = written(_clusters(classes), "near-clusters")
    n = clusters.count()
    # only the clusters' documents make their sets: their ids are broadcast if so few, else joined
    ids = clusters.select(F.col("node").alias("doc_id"))
    wanted = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sizes = clusters.groupBy("c").agg(F.count("*").alias("size"))
    about = clusters.join(sizes, "c").withColumnRenamed("node", "doc_id")
    members = written(_full_sets(wanted, k).join(about, "doc_id").withColumnRenamed("doc_id", "node"), "near-members")
    labels = components(written(_links(members, percent), "near-links"))
    named = classes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.coalesce(F.col("label"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` less all but one document of each group: the one of the smallest
    doc_id, null last.  A row is known by its id and its text together, so rows
    with null or equal ids are as separate as any others; of rows that repeat
    the kept id and text, one stays."""
    at = F.col("doc_id")
    keyed = boxed(docs, "doc_id", "text").withColumn("__key", F.xxhash64(at, at.isNull(), "text", F.col("text").isNull()))
    groups = near_groups(keyed.select(F.col("__key").alias("doc_id"), "text"), k, percent)
    groups = groups.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct()
    kept = keyed.select("__key", "doc_id").join(groups, "__key").groupBy("__group").agg(F.min_by("__key", F.struct(at.isNull(), at, F.col("__key"))).alias("__key"))
    one = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
    out = keyed.join(kept.select("__key"), "__key", "left_semi").withColumn("__one", one).filter("__one = 1")
    return unboxed(out, docs.columns, ("doc_id", "text"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir))


#: All pairs that share a shingle, compared exactly; ids are distinct.
OP7_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common c JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b
    WHERE 100 * c.n >= {PERCENT} * (u.n + v.n - c.n)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), named AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM named LEFT JOIN sizes USING (doc_id)
"""
