"""Line dedup: lines that many documents share stay only in the last of them.

Method: sharded minimal perfect hash.  Every distinct line (as a 128-bit hash
of its key) belongs to a shard; each shard gets a minimal perfect hash
function, a cascade of bit arrays in which a key takes the first level where no
other key meets it, its slot being the rank of its bit.  The function indexes
three compact arrays: fingerprints, document counts and last documents.
Documents send their line hashes to the shards, which answer from the arrays;
there is no join of lines.

Shards hold about ``SHARD_KEYS`` lines.  A shard whose lines occur often (one
line may be in a third of all documents) is copied, so that each copy answers
about ``PROBES`` probes, and is read one batch at a time.  A line's key is the
line without white space at both ends and with A-Z lower-cased; keys of fewer
than ``min_chars`` code points are left alone.

A null text is one empty line.  Rows with equal ids are one document when
documents are counted (null is an id), and each keeps its lines if that id is the line's last.  A null id is
smaller than all others; ids may be of any type with an order.  An empty table gives an empty result.  Other columns
are carried; those named like a computed one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, boxed, column, lean, load, mix64, unboxed, written

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 50_000
PROBES = 200_000
GAMMA = 1.7  # bits of a level for each key that reaches it


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to matter."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key.lower()  # of bytes: A-Z only


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit values."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            upto = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(upto + (total - 1))
            total += int(upto[-1]) if len(upto) else 0

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(a + np.uint64(2 * level + 1) * b) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(2, int(GAMMA * len(a)))
            at = cls._place(a, b, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = ~bits[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys; for others any slot, or -1."""
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            at = self._place(a[todo], b[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        return out

    def pack(self) -> tuple[list[int], list[bytes]]:
        return [len(x) for x in self.levels], [np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpack(cls, sizes: list[int], packed: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) for n, p in zip(sizes, packed, strict=True)])


def _probes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each document's distinct line hashes: a, b, doc_id."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, rows = column(batch, "doc_id"), [], []
            for k, text in enumerate(column(batch, "text")):
                if (text := text.as_py()) is None:
                    continue
                keys = {key for line in text.encode().split(b"\n") if (key := line_key(line, min_chars))}
                a += map(_hash, keys)
                rows += [k] * len(keys)
                if len(rows) >= 50_000 or (rows and k + 1 == len(ids)):
                    both = np.frombuffer(b"".join(a), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), ids.take(pa.array(rows))], names=["a", "b", "doc_id"])
                    a, rows = [], []
            if rows:
                both = np.frombuffer(b"".join(a), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), ids.take(pa.array(rows))], names=["a", "b", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"a long, b long, doc_id {kind}")


ARRAYS = "shard int, probes long, sizes array<long>, levels array<binary>, prints binary, counts binary, last binary"


def _build(lines: DataFrame) -> DataFrame:
    """Arrays of every shard, from its lines (shard, a, b, n, last_doc)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, b = (t.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        mph = PerfectHash.build(a, b)
        slot = mph.slots(a, b)
        prints, counts, last = np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        prints[slot] = (b >> np.uint64(32)).astype(np.uint32)
        counts[slot] = t.column("n").to_numpy()
        last[slot] = pc.fill_null(t.column("last_doc"), np.iinfo(np.int64).min).to_numpy()
        sizes, levels = mph.pack()
        row = {"shard": key[0].as_py(), "probes": int(counts.sum()), "sizes": sizes, "levels": levels, "prints": prints.tobytes(), "counts": counts.tobytes(), "last": last.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("probes", pa.int64()), ("sizes", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), *((c, pa.binary()) for c in ("prints", "counts", "last"))]))

    return lines.groupBy("shard").applyInArrow(run, ARRAYS)


def _name(doc_id: Column, kind: str) -> Column:
    """A document as a 64-bit number: its id, or a hash if that is no integer."""
    return doc_id.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(doc_id.isNotNull(), F.xxhash64(doc_id))


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and ``hashes``: the 16-byte hashes, end to end, of the lines that
    the document loses."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    probes = _probes(docs, min_chars)
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        probes = probes.distinct()  # a line counts once for an id, however many rows have it
    probes = written(probes, "line-probes")
    lines = written(probes.groupBy("a", "b").agg(F.count("*").alias("n"), _name(F.max("doc_id"), id_type).alias("last_doc")), "line-counts")
    n_shards = max(1, -(-lines.count() // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("a"), F.lit(n_shards)).cast("int")
    arrays = written(_build(lines.withColumn("shard", shard)), "line-arrays")
    # copies of a shard, so that none answers more than about PROBES; shard and copy
    # are of one type on both sides, as rows are dealt by the hash of int or long
    copies = arrays.select("shard", F.ceil(F.col("probes") / PROBES).cast("int").alias("copies"))
    asked = probes.withColumn("known", _name(F.col("doc_id"), id_type)).withColumn("shard", shard).join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "b"), F.col("copies")).cast("int"))
    served = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("probes") / PROBES).cast("int") - 1)))

    def answer(key: tuple, asking: pa.Table, held: pa.Table) -> pa.Table:
        if asking.num_rows and not held.num_rows:
            raise ValueError("lines were sent to a task that does not hold their shard")
        if asking.num_rows == 0:
            return pa.table({"doc_id": asking.column("doc_id").slice(0, 0), "hash": pa.array([], pa.binary())})
        row = {c: held.column(c)[0].as_py() for c in ("sizes", "levels", "prints", "counts", "last")}
        mph = PerfectHash.unpack(row["sizes"], row["levels"])
        prints, counts, last = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["last"], np.int64)
        a, b = (asking.column(c).to_numpy() for c in ("a", "b"))
        ids = asking.column("doc_id").combine_chunks() if hasattr(asking.column("doc_id"), "combine_chunks") else asking.column("doc_id")
        known = pc.fill_null(asking.column("known"), np.iinfo(np.int64).min).to_numpy()
        slot = mph.slots(a.view(np.uint64), b.view(np.uint64))
        goes = (slot >= 0) & (prints[slot] == (b.view(np.uint64) >> np.uint64(32)).astype(np.uint32)) & (counts[slot] >= min_docs) & (last[slot] != known)
        at = np.flatnonzero(goes)
        whole = np.stack([a[at], b[at]], axis=1).tobytes()
        return pa.table({"doc_id": ids.take(pa.array(at)), "hash": pa.array([whole[16 * k : 16 * k + 16] for k in range(len(at))], pa.binary())})

    answers = asked.groupBy("shard", "copy").cogroup(served.groupBy("shard", "copy")).applyInArrow(answer, f"doc_id {id_type}, hash binary")
    return answers.groupBy("doc_id").agg(F.array_join(F.collect_set(F.hex("hash")), "").alias("hashes"))


def _kept(text: str | None, goes: frozenset[bytes] | set[bytes], min_chars: int) -> tuple[int, list[bytes]]:
    lines = (text or "").encode().split(b"\n")
    if not goes:
        return len(lines), lines
    return len(lines), [x for x in lines if (key := line_key(x, min_chars)) is None or _hash(key) not in goes]


def _split_hashes(joined: str | None) -> set[bytes]:
    raw = bytes.fromhex(joined or "")
    return {raw[k : k + 16] for k in range(0, len(raw), 16)}


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """``docs`` with its texts less the lines dropped, and n_lines, n_dropped;
    with ``digest``, doc_id and kept_sha256 in place of the other columns."""
    lost = shared_lines(docs, min_docs, min_chars)
    d = (docs.select("doc_id", "text") if digest else boxed(docs, "doc_id", "text")).alias("d")
    both = d.join(lost.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left").select("d.*", F.col("l.hashes").alias("__hashes"))
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    carried = [f for f in d.schema if f.name != "text"]
    schema = T.StructType([*carried, *counts, T.StructField("kept_sha256" if digest else "text", T.StringType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, out = [], [], []
            for text, hashes in zip(column(batch, "text"), column(batch, "__hashes"), strict=True):
                n, kept = _kept(text.as_py(), _split_hashes(hashes.as_py()), min_chars)
                total.append(n)
                dropped.append(n - len(kept))
                whole = b"\n".join(kept)
                out.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in carried), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], names=schema.names)

    out = both.mapInArrow(run, schema)
    # the text comes last, before the counts
    columns = [*(c for c in docs.columns if c != "text"), "text"]
    return out if digest else unboxed(out, columns, ("doc_id", "text"), {c: F.col(c) for c in ("n_lines", "n_dropped")})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir), digest=True)


#: The same rows by joins and windows, for DuckDB.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, k, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT d.doc_id, d.k, d.line, (o.key IS NOT NULL AND o.last_doc <> d.doc_id) AS goes FROM keyed d LEFT JOIN often o ON d.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
