"""Merkle manifest of a dataset: a leaf for each row, a tree for each language,
and one tree over these, with an inclusion proof for every leaf.

Method: time-forward processing.  Nodes are labelled by level and place, so that
children come before parents.  A priority queue ordered by label hands child
digests to their parent; when a label is the least, all its children have
arrived, the node is hashed and sends its digest on.  The reversed sweep takes
labels from the greatest down and hands proof suffixes from parents to children:
what the parent got, behind the siblings of the child.

The queue is external: blocks of ``BLOCK`` consecutive nodes are one task's work
in memory, and what leaves a block (its top digest, later its proof suffix) is
a row of a table in the shared folder, sorted by the block it is for.  A round
of blocks shrinks a tree by ``BLOCK``; no task holds more than one block, however
large a language is.

Order: languages with nulls first, then by UTF-8 bytes; leaves by doc_id (nulls
first), equal ids by their leaf digest.  A null in a leaf is ``-``.  Repeated
rows are leaves of their own, with equal digests and proofs of their own places.
An empty table has no rows.  Other columns are ignored, under any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import ranked
from .common import LOWER, UPPER, column, lean, load, written

#: Children of a node, levels of a block, and nodes that a block begins with.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One leaf in so many is tampered with in op13.
TAMPER = 3


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row; ``changed`` columns take the place of its own."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(f"`{c}`"))) for c in FIELDS)), 256)


def _h(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def _widths(n: int) -> list[int]:
    """Nodes of each level of a tree over ``n`` of them, up to a block's top."""
    out = [n]
    while out[-1] > 1 and len(out) <= LEVELS:
        out.append(-(-out[-1] // FAN))
    return out


def _risen(first: int, n: int, digests: list[bytes]) -> list[dict[int, bytes]]:
    """All nodes of the block that begins at ``first`` in a tree of ``n``: for
    each level, digests by place."""
    top = len(_widths(n)) - 1
    levels: list[dict[int, bytes]] = [{} for _ in range(top + 1)]
    queue = [((0, first + k), 0, d) for k, d in enumerate(digests)]  # in order, so a heap
    while queue:
        label = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        level, place = label
        digest = children[0] if level == 0 else _h(children)
        levels[level][place] = digest
        if level < top:
            heapq.heappush(queue, ((level + 1, place // FAN), place, digest))
    return levels


def _fallen(levels: list[dict[int, bytes]], proof: bytes, shape: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Place, proof and shape of each first-level node of a block, whose top has
    the proof and shape given; the places come falling."""
    queue = [((-(len(levels) - 1), -k), proof, shape) for k in levels[-1]]
    while queue:
        (level, place), proof, shape = heapq.heappop(queue)
        if level == 0:
            yield -place, proof, shape
            continue
        below = levels[-level - 1]
        run = [k for k in range(-place * FAN, (1 - place) * FAN) if k in below]
        for k, child in enumerate(run):
            siblings = b"".join([below[x] for x in run if x != child])
            heapq.heappush(queue, ((level + 1, -child), siblings + proof, bytes([k * FAN + len(run) - 1 - k]) + shape))


def folded(digest: bytes, proof: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its siblings lead to.  ``proof`` holds the
    siblings' digests level by level, left to right; a byte of ``shape`` for each
    level says how many are before (times eight) and behind the node."""
    at = 0
    for s in shape:
        before, n = s // FAN, s // FAN + s % FAN
        some = [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(n)]
        digest = _h([*some[:before], digest, *some[before:]])
        at += 32 * n
    return digest


# blocks over Spark

_NODES = "tree string, place long, n long, digest binary"


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """Tree, first place, size of the tree and rows (of the columns ``names``)
    of each block of batches sorted by tree and place."""
    key, rows, size = None, [], 0
    for b in batches:
        cols = [column(b, c).to_pylist() for c in names]
        for tree, place, n, *row in zip(*(column(b, c).to_pylist() for c in ("tree", "place", "n")), *cols, strict=True):
            if key != (tree, place // BLOCK):
                if key is not None:
                    yield key[0], key[1] * BLOCK, size, rows
                key, rows = (tree, place // BLOCK), []
            rows.append(tuple(row))
            size = n
    if key is not None:
        yield key[0], key[1] * BLOCK, size, rows


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes by block, sorted by label."""
    return nodes.repartition("tree", F.floor(F.col("place") / BLOCK)).sortWithinPartitions("tree", F.floor(F.col("place") / BLOCK), *order, "place")


@lean
def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for tree, first, n, rows in _blocks(batches, ("digest",)):
        (top,) = _risen(first, n, [d for (d,) in rows])[-1].values()
        out.append((tree, first // BLOCK, -(-n // BLOCK), top))
        if len(out) == BLOCK:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "place", "n", "digest"])


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, place, n, digest), each with the tops of the blocks
    of the one before; the last has the root of every tree."""
    tables = [nodes]
    while not tables[-1].filter("n > 1").isEmpty():
        up = _dealt(tables[-1].select("tree", "place", "n", "digest")).mapInArrow(_rise, _NODES)
        tables.append(written(up, "merkle-nodes"))
    return tables


def descend(tables: list[DataFrame], suffixes: DataFrame, emit: Callable[[list[tuple], list[tuple[bytes, bytes]]], pa.RecordBatch], schema: str, carried: tuple[str, ...]) -> DataFrame:
    """Hands proofs down the tables of ``climb``.  ``suffixes`` (tree, proof,
    shape, subroot) is what the roots get.  For the first table's nodes, ``emit``
    gets the rows (digest, subroot, ``carried``) and their proofs and shapes."""
    messages = suffixes.withColumn("place", F.lit(0).cast("long"))
    for nodes in reversed(tables[1:]):
        messages = written(_handed(nodes, messages, _message, "tree string, place long, proof binary, shape binary, subroot string", ()), "merkle-proofs")
    return _handed(tables[0], messages, emit, schema, carried)


def _message(rows: list[tuple], proofs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    trees, places, _, subroots = zip(*(r[:4] for r in rows), strict=True)
    data = [pa.array(trees, pa.string()), pa.array(places, pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*proofs, strict=True)), pa.array(subroots, pa.string())]
    return pa.RecordBatch.from_arrays(data, names=["tree", "place", "proof", "shape", "subroot"])


def _handed(nodes: DataFrame, messages: DataFrame, emit: Callable, schema: str, carried: tuple[str, ...]) -> DataFrame:
    """A message is for the block of its place; it comes before the block's nodes."""
    gone = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    sent = messages.select("tree", (F.col("place") * BLOCK).alias("place"), F.lit(0).cast("long").alias("n"), none("digest", "binary"), "proof", "shape", "subroot", *gone)
    own = nodes.select("tree", "place", "n", "digest", none("proof", "binary"), none("shape", "binary"), none("subroot", "string"), *carried)
    both = own.unionByName(sent).withColumn("own", F.col("proof").isNull())
    names = ("place", "digest", "proof", "shape", "subroot", *carried)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, first, n, rows in _blocks(batches, names):
            (_, _, proof, shape, subroot, *_), rows = rows[0], rows[1:]
            levels = _risen(first, n, [r[1] for r in rows])
            proofs = {k: (p, s) for k, p, s in _fallen(levels, proof, shape)}
            yield emit([(tree, r[0], r[1], subroot, *r[5:]) for r in rows], [proofs[r[0]] for r in rows])

    return _dealt(both, "own").mapInArrow(run, schema)


def _key(c: Column) -> Column:
    """A language as the name of a tree, null apart from all; the order of the
    names is that of the languages."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def proved(df: DataFrame, emit: Callable, schema: str, **more: Column) -> tuple[DataFrame, str | None]:
    """``emit``'s rows for all leaves of ``df``, and the root (None if there are
    no rows).  Emitted rows are (tree, place, digest, subroot, doc_id, more...)."""
    own = df.select(_key(F.col("lang").cast("string")).alias("tree"), "doc_id", F.unhex(leaf()).alias("digest"), *(c.alias(k) for k, c in more.items()))
    # the texts are read and hashed once; only digests are shuffled
    placed = ranked(written(own, "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest")], "place", by=("tree",), total="n")
    nodes = written(placed.select("tree", "place", "n", "digest", "doc_id", *more), "merkle-nodes")
    tables = climb(nodes)
    subroots = _over(tables[-1])
    upper = climb(subroots)
    top = upper[-1].first()
    if top is None:
        return df.sparkSession.createDataFrame([], schema), None
    start = df.sparkSession.createDataFrame([("", bytearray(), bytearray(), "")], "tree string, proof binary, shape binary, subroot string")
    suffixes = written(descend(upper, start, _tree_message, "tree string, proof binary, shape binary, subroot string", ("lang",)), "merkle-proofs")
    return descend(tables, suffixes, emit, schema, ("doc_id", *more)), bytes(top["digest"]).hex()


def _over(roots: DataFrame) -> DataFrame:
    """The roots of all trees as the nodes of one more."""
    placed = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), [F.col("lang")], "place", by=("tree",), total="n")
    return written(placed.select("tree", "place", "n", "digest", "lang"), "merkle-subroots")


def _tree_message(rows: list[tuple], proofs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    data = [pa.array([r[4] for r in rows], pa.string()), *(pa.array(x, pa.binary()) for x in zip(*proofs, strict=True)), pa.array([r[2].hex() for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(data, names=["tree", "proof", "shape", "subroot"])


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings' digests, binary, level by
    level and left to right) and shape (see ``folded``) of every row."""
    of = df.schema["doc_id"].dataType
    kind, arrow = of.simpleString(), to_arrow_type(of)

    def emit(rows: list[tuple], proofs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        _, _, leaves, subroots, ids = zip(*rows, strict=True)
        data = [pa.array(ids, arrow), pa.array([x.hex() for x in leaves]), pa.array(subroots, pa.string()), *(pa.array(x, pa.binary()) for x in zip(*proofs, strict=True))]
        return pa.RecordBatch.from_arrays(data, names=["doc_id", "leaf", "subroot", "proof", "shape"])

    out, root = proved(df, emit, f"doc_id {kind}, leaf string, subroot string, proof binary, shape binary")
    return out.withColumn("root", F.lit(root))


def verified(df: DataFrame, tampered: Column) -> DataFrame:
    """The manifest with digests of its proofs; rows for which ``tampered`` holds
    have A-Z of their text lower-cased when their leaf is checked again."""
    of = df.schema["doc_id"].dataType
    kind, arrow = of.simpleString(), to_arrow_type(of)
    other = F.when(tampered, F.unhex(leaf(text=F.translate("text", UPPER, LOWER))))

    def emit(rows: list[tuple], proofs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        _, _, leaves, subroots, ids, others = zip(*rows, strict=True)
        said = [hashlib.sha256(p.hex().encode()).hexdigest() for p, _ in proofs]
        ends = [folded(b or a, *p).hex() for a, b, p in zip(leaves, others, proofs, strict=True)]
        data = [pa.array(ids, arrow), pa.array([x.hex() for x in leaves]), pa.array(subroots, pa.string()), pa.array(said), pa.array(ends)]
        return pa.RecordBatch.from_arrays(data, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    out, root = proved(df, emit, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", other=other)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


#: CRC-32 of a text's bytes in DuckDB: the table of the polynomial, then a fold.
CRC_TABLE = "(SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, where ``crc.t`` is ``CRC_TABLE``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[CAST((xor(c, b) & 255) + 1 AS INT)])))"


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(text if c == 'text' else c) for c in FIELDS)})"


OP13_SQL = f"""WITH RECURSIVE crc AS {CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPER} = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents, crc),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
placed AS (SELECT l.*, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY t.tree) AS n FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang),
nodes AS (SELECT tree, 0 AS level, place, leaf AS d, n FROM placed
  UNION ALL SELECT tree, level + 1, place // {FAN}, sha256(string_agg(d, '' ORDER BY place)), any_value((n + {FAN - 1}) // {FAN}) FROM nodes WHERE n > 1 GROUP BY tree, level, place // {FAN}),
subroots AS (SELECT tree, d, (SELECT count(*) FROM trees) AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS place, d, n FROM subroots
  UNION ALL SELECT level + 1, place // {FAN}, sha256(string_agg(d, '' ORDER BY place)), any_value((n + {FAN - 1}) // {FAN}) FROM tops WHERE n > 1 GROUP BY level, place // {FAN}),
root AS (SELECT d FROM tops WHERE n = 1), height AS (SELECT tree, max(level) AS h FROM nodes GROUP BY tree),
every AS (SELECT tree, level, place, d FROM nodes UNION ALL SELECT t.tree, h.h + p.level + 1, p.place, p.d FROM tops p, trees t JOIN height h ON t.tree = h.tree WHERE p.n > 1),
steps AS (SELECT p.tree, p.place AS leaf_place, e.level, e.place, e.d, e.place = w.own AS own FROM placed p JOIN height h ON p.tree = h.tree,
  LATERAL (SELECT l AS level, CASE WHEN l < h.h THEN p.place // CAST(pow({FAN}, l) AS BIGINT) ELSE p.tree // CAST(pow({FAN}, l - h.h - 1) AS BIGINT) END AS own FROM (SELECT unnest(range(h.h + 1 + (SELECT max(level) FROM tops))) AS l) WHERE l <> h.h) w
  JOIN every e ON e.tree = p.tree AND e.level = w.level AND e.place // {FAN} = w.own // {FAN}),
proofs AS (SELECT tree, leaf_place, string_agg(d, '' ORDER BY level, place) FILTER (WHERE NOT own) AS proof FROM steps GROUP BY tree, leaf_place),
folds AS (SELECT tree, place AS leaf_place, 0 AS k, coalesce(other, leaf) AS d FROM placed
  UNION ALL SELECT f.tree, f.leaf_place, f.k + 1, CASE WHEN count(s.d) = 0 THEN any_value(f.d) ELSE sha256(string_agg(CASE WHEN s.own THEN f.d ELSE s.d END, '' ORDER BY s.place)) END
  FROM folds f LEFT JOIN steps s ON s.tree = f.tree AND s.leaf_place = f.leaf_place AND s.level = f.k WHERE f.k <= (SELECT max(level) FROM every) GROUP BY f.tree, f.leaf_place, f.k)
SELECT p.doc_id, p.leaf, s.d AS subroot, root.d AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree JOIN folds f ON f.tree = p.tree AND f.leaf_place = p.place AND f.k = (SELECT max(k) FROM folds) LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_place = p.place, root"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(load(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0)
