"""Suffix-array dedup: removes every byte that a string of ``LENGTH`` bytes
covers which also starts elsewhere, in the same document or another.

Method: logarithmic index family.  Suffixes are known by a 64-bit fingerprint
of their first bytes, so the suffix array of a batch is its suffixes sorted by
fingerprint, and arrays merge and scan eight bytes at a time.  The fingerprints
are dealt to shards by value.  In a shard every new batch gets its array, is
merge-scanned against the arrays of all existing levels for equal prefixes, and
the suffixes that are new form a level that merges with levels of equal size,
geometrically (``Family``).

Not all suffixes are needed.  A string's anchor is the position of the least
16-byte hash in its first ``SPAN`` bytes, so equal strings have equal anchors, and
strings that start side by side share theirs.  First, each anchor asks for two
suffixes: the one that starts at the anchor, by the bytes that all its strings
contain, and the one that starts with its first string, up to the end of its
last.  Where the second repeats, so do all its strings; where not even the first
does, none can.  Then only the suffixes between are
asked for one by one (at the ends of matches), with one representative of each
repeated second one, for them to be found.  A pack of rows asks for each
fingerprint once, so that a passage of a third of all documents is no hot key.

Null and empty texts have no bytes.  Equal rows are copies of each other; other
rows that share an id are separate documents.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, lean, load, mix64, pieces, written

LENGTH = 200
GRAM = 16
SPAN = 150
#: Bytes from the anchor on that all its strings contain.
SHORT = LENGTH - (SPAN - GRAM)
SHARD = 1_000_000  # suffixes of a shard
BATCH = 125_000  # suffixes of a batch
GONE, REPEATED, SHOWN = 0, 1, 2  # verdicts: alone; repeated; repeated, and it stands for the others

_rng = np.random.Generator(np.random.PCG64(31337))
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 5
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return [p[:n] for p in _POWERS]


class Prints:
    """Fingerprints of any substring of a piece."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.add.accumulate(_VALUE[data] * up[:-1])]).astype(np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def all(self, n: int) -> np.ndarray:
        """Of every substring of n bytes."""
        return mix64((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _slide(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Best of every w neighbours."""
    n = 1
    while 2 * n <= w:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(prints: Prints, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes by their anchor: the anchors, and the first and
    last start of the strings that have it."""
    none = np.zeros(0, np.int64)
    if int(offs[-1]) < LENGTH:
        return none, none, none
    # half the hash, and the position: the least is leftmost among equals
    gram = prints.all(GRAM)
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.arange(len(gram), dtype=np.uint64)
    anchor = (_slide(gram, SPAN - GRAM + 1, np.minimum)[: int(offs[-1]) - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.ones(len(anchor), bool)
    for end in offs[1:-1].tolist():
        fits[max(0, end - LENGTH + 1) : end] = False
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    end = fits.copy()
    end[:-1] &= (anchor[1:] != anchor[:-1]) | ~fits[1:]
    first = np.flatnonzero(new)
    return anchor[first], first, np.flatnonzero(end)


class Rows:
    """The anchors of a piece by row, and what they ask for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.offs, self.prints = offs, Prints(data)
        self.at, self.first, self.last = anchors(self.prints, offs)
        self.cut = np.searchsorted(self.first, offs)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of both suffixes of each anchor, by turns, and where
        each row's begin."""
        out = np.empty(2 * len(self.at), np.uint64)
        out[::2] = self.prints.of(self.at, self.at + SHORT)
        out[1::2] = self.prints.of(self.first, self.last + LENGTH)
        return out, 2 * self.cut

    def starts(self, row: int, verdict: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """From the verdicts on a row's anchors: runs of starts (from, to) of
        repeated strings, and runs that must ask themselves."""
        a, b = self.cut[row], self.cut[row + 1]
        runs = list(zip((self.first[a:b] - self.offs[row]).tolist(), (self.last[a:b] - self.offs[row] + 1).tolist(), strict=True))
        short, whole = verdict[::2], verdict[1::2]
        return [runs[k] for k in np.flatnonzero(whole)], [runs[k] for k in np.flatnonzero((whole == SHOWN) | ((whole == GONE) & (short > 0)))]


# the index family


class Family:
    """Sorted arrays of distinct fingerprints in levels of geometric sizes."""

    def __init__(self, n: int):
        self.verdict = np.zeros(n, np.uint8)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, first: int) -> None:
        """A new batch, whose suffixes are numbered from ``first``."""
        order = np.argsort(prints, kind="stable")
        s = prints[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(s)))
        ids = first + order
        self.verdict[ids[~new]] = REPEATED
        s, ids, own = s[at], ids[at], counts > 1
        self.verdict[ids[own]] = SHOWN
        for held, of in self.levels:
            place = np.minimum(np.searchsorted(held, s), len(held) - 1)
            hit = held[place] == s
            self.verdict[of[place[hit]]] = SHOWN
            self.verdict[ids[hit]] = REPEATED
            s, ids = s[~hit], ids[~hit]
        if not len(s):
            return
        level = (s, ids)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            held, of = self.levels.pop()
            both = np.concatenate([held, level[0]])
            order = np.argsort(both, kind="stable")  # merges two sorted runs
            level = (both[order], np.concatenate([of, level[1]])[order])
        self.levels.append(level)


ASK = "pack long, shard int, prints binary, rows binary, keys binary, told binary"
_ASK = pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("prints", pa.binary()), ("rows", pa.binary()), ("keys", pa.binary()), ("told", pa.binary())])


def packs() -> Iterator[int]:
    """Numbers for this task's packs, the same when it runs again."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def _questions(pack: int, keys: list[tuple[int, int]], prints: np.ndarray, begin: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Asks for each fingerprint of a pack of rows once: one row for each shard,
    with the row of each (``rows``).  What the pack itself
    tells goes in a row with the keys: GONE, or REPEATED (it isn't asked for) or
    SHOWN (asked for, in the name of the pack's others)."""
    if not len(prints):
        return
    order = np.argsort(prints, kind="stable")
    s = prints[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    told = np.zeros(len(prints), np.uint8)
    told[order[same]] = REPEATED
    told[order[np.append(same[1:], False) & ~same]] = SHOWN
    row = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(begin))
    yield pa.RecordBatch.from_pylist([{"pack": pack, "shard": pack % shards, "rows": row.tobytes(), "keys": np.array(keys, np.int64).tobytes(), "told": told.tobytes()}], _ASK)
    sent = np.flatnonzero(told != REPEATED)
    where = (prints[sent] % np.uint64(shards)).astype(np.int32)
    by = np.argsort(where, kind="stable")
    sent, where = sent[by], where[by]
    cut = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
    rows = [{"pack": pack, "shard": int(where[c]), "prints": prints[sent[c:d]].tobytes(), "rows": row[sent[c:d]].tobytes()} for c, d in zip(cut[:-1], cut[1:], strict=True)]
    for k in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], _ASK)


def _answers(asked: DataFrame) -> DataFrame:
    """By row (k1, k2): a list of the shards' verdicts (shard -1: its own pack's)."""

    def family(t: pa.Table) -> pa.Table:
        prints = [x.as_py() or b"" for x in t.column("prints")]
        sizes = np.array([len(x) // 8 for x in prints])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(prints), np.uint64)
        index = Family(len(flat))
        for at in range(0, len(flat), BATCH):
            index.add(flat[at : at + BATCH], at)
        own = [x.as_py() for x in t.column("told")]
        marks = [o if o is not None else index.verdict[begin[k] : begin[k + 1]].tobytes() for k, o in enumerate(own)]
        shard = [-1 if o is not None else x for o, x in zip(own, t.column("shard").to_pylist(), strict=True)]
        return pa.table({"pack": t.column("pack"), "shard": pa.array(shard, pa.int32()), "rows": t.column("rows"), "keys": t.column("keys"), "marks": pa.array(marks, pa.binary())})

    def by_row(t: pa.Table) -> pa.Table:
        """A pack's verdicts, by its rows."""
        keys, out = None, {}
        for r in t.to_pylist():
            if r["keys"] is not None:
                keys = np.frombuffer(r["keys"], np.int64).reshape(-1, 2)
            row, marks = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["marks"], np.uint8)
            some = np.unique(row[marks > 0])  # rows stand in order
            for k, c, d in zip(some.tolist(), np.searchsorted(row, some).tolist(), np.searchsorted(row, some, "right").tolist(), strict=True):
                out.setdefault(k, []).append({"shard": r["shard"], "marks": marks[c:d].tobytes()})
        rows = sorted(out)
        some = keys[rows] if rows else np.zeros((0, 2), np.int64)
        return pa.table({"k1": pa.array(some[:, 0]), "k2": pa.array(some[:, 1]), "answers": pa.array([out[k] for k in rows], pa.list_(pa.struct([("shard", pa.int32()), ("marks", pa.binary())])))})

    kind = "array<struct<shard: int, marks: binary>>"
    got = asked.groupBy("shard").applyInArrow(family, "pack long, shard int, rows binary, keys binary, marks binary")
    return got.groupBy("pack").applyInArrow(by_row, f"k1 long, k2 long, answers {kind}").groupBy("k1", "k2").agg(F.flatten(F.collect_list("answers")).alias("answers"))


def _verdicts(prints: np.ndarray, answers: list[dict] | None, shards: int) -> np.ndarray:
    """The verdict on each of a row's fingerprints, from what the shards said."""
    out = np.zeros(len(prints), np.uint8)
    if not answers or not len(prints):
        return out
    if len({x["shard"] for x in answers}) < len(answers):  # equal rows have asked too: all repeats
        out[:] = SHOWN
        return out
    own = next((np.frombuffer(x["marks"], np.uint8) for x in answers if x["shard"] == -1), out)
    out = own.copy()
    where = (prints % np.uint64(shards)).astype(np.int32)
    sent = own != REPEATED
    for x in answers:
        if x["shard"] >= 0:
            to = np.flatnonzero(sent & (where == x["shard"]))
            out[to] = np.maximum(out[to], np.frombuffer(x["marks"], np.uint8))
    return out


def _key(docs: DataFrame) -> DataFrame:
    """Rows by their content: equal rows have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", F.lit("row")).alias("k1"), F.xxhash64(text, F.col("doc_id")).alias("k2"))


def _keys(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    return list(zip(column(batch, "k1").to_pylist(), column(batch, "k2").to_pylist(), strict=True))


def _kept(text: bytes, starts: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, runs, and the digest of what stays."""
    if not starts:
        return 0, 0, hashlib.sha256(text).hexdigest()
    edge = np.zeros(len(text) + 1, np.int64)
    for a, b in starts:
        edge[a] += 1
        edge[b - 1 + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def _runs(flat: bytes) -> list[tuple[int, int]]:
    return [tuple(x) for x in np.frombuffer(flat, np.int64).reshape(-1, 2).tolist()]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = _key(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(total * 4 // (SPAN * SHARD))

    @lean
    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = packs()
        for batch in batches:
            keys, prints, begin, n = [], [], [np.zeros(1, np.int64)], 0
            every = _keys(batch)
            for start, end, data, offs in pieces(column(batch, "text")):
                got, cut = Rows(data, offs).asked()
                keys += every[start:end]
                prints.append(got)
                begin.append(cut[1:] + n)
                n += len(got)
            if n:
                yield from _questions(next(number), keys, np.concatenate(prints), np.concatenate(begin), shards)

    answers = written(_answers(rows.mapInArrow(ask_anchors, ASK)), "suffix-anchors")

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, said = column(batch, "text"), column(batch, "answers")
            for start, end, data, offs in pieces(text):
                some = [k for k in range(start, end) if said[k].is_valid]
                out: dict[int, tuple] = {}
                if some:
                    parts = [data[offs[k - start] : offs[k - start + 1]] for k in some]
                    part = Rows(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
                    prints, cut = part.asked()
                    for j, k in enumerate(some):
                        sure, ask = part.starts(j, _verdicts(prints[cut[j] : cut[j + 1]], said[k].as_py(), shards))
                        if sure or ask:
                            out[k] = (sure, ask)
                cols: list[list] = [[], [], [], [], [], []]
                for k in range(start, end):
                    x = data[offs[k - start] : offs[k - start + 1]].tobytes()
                    sure, ask = out.get(k, ([], []))
                    cols[0].append(len(x))
                    cols[1].append(None if ask or sure else hashlib.sha256(x).hexdigest())
                    cols[2].append(x.decode() if ask or sure else None)
                    cols[3].append(np.array(sure, np.int64).tobytes())
                    cols[4].append(np.array(ask, np.int64).tobytes())
                    cols[5].append(sum(b - a for a, b in ask))
                n = end - start
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(start, n) for c in ("doc_id", "k1", "k2")), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True))], names=["doc_id", "k1", "k2", "n_bytes", "sha", "text", "sure", "ask", "asks"])

    first = written(rows.join(answers, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "answers").mapInArrow(decide, f"doc_id {id_type}, k1 long, k2 long, n_bytes long, sha string, text string, sure binary, ask binary, asks long"), "suffix-first")
    open_ = first.filter("text IS NOT NULL")
    asks = open_.agg(F.sum("asks")).first()[0] or 0
    more = 1 + int(asks // SHARD)

    def windows(data: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
        at = np.concatenate([np.arange(a, b) for a, b in runs]) if runs else np.zeros(0, np.int64)
        return Prints(data).of(at, at + LENGTH) if len(at) else np.zeros(0, np.uint64)

    @lean
    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = packs()
        for batch in batches:
            every, runs = _keys(batch), column(batch, "ask")
            keys, prints, begin = [], [], [0]
            for k, (text, r) in enumerate(zip(column(batch, "text"), runs, strict=True)):
                got = windows(np.frombuffer(text.as_py().encode(), np.uint8), _runs(r.as_py()))
                keys.append(every[k])
                prints.append(got)
                begin.append(begin[-1] + len(got))
                if begin[-1] > 2_000_000:
                    yield from _questions(next(number), keys, np.concatenate(prints), np.array(begin), more)
                    keys, prints, begin = [], [], [0]
            if keys:
                yield from _questions(next(number), keys, np.concatenate(prints), np.array(begin), more)

    last = written(_answers(open_.filter("asks > 0").select("k1", "k2", "text", "ask").mapInArrow(ask_windows, ASK)), "suffix-windows")

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, sure, ask, said in zip(*(column(batch, c) for c in ("text", "sure", "ask", "answers")), strict=True):
                x = text.as_py().encode()
                starts, runs = _runs(sure.as_py()), _runs(ask.as_py())
                if said.is_valid:
                    v = _verdicts(windows(np.frombuffer(x, np.uint8), runs), said.as_py(), more) > 0
                    at = np.concatenate([np.arange(a, b) for a, b in runs])[v]
                    starts += [(p, p + 1) for p in at.tolist()]
                out.append(_kept(x, starts))
            n, runs, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(list(n), pa.int64()), pa.array(list(runs), pa.int64()), pa.array(list(sha))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = open_.join(last, ["k1", "k2"], "left").select("doc_id", "n_bytes", "text", "sure", "ask", "answers").mapInArrow(finish, schema)
    whole = first.filter("text IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return done.union(whole)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(load(spark, sf_dir))


#: Every string of LENGTH bytes of every document (as hex digits, two a byte)
#: by its digest, in blocks of 1,000 starts; ids are distinct.
OP6_SQL = f"""
WITH docs AS (
    SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), blocks AS (
    SELECT doc_id, 1000 * b AS first, substr(h, 2000 * b + 1, 2 * {1000 + LENGTH - 1}) AS part
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS b FROM docs)
), strings AS (
    SELECT doc_id, first + k AS k, md5_number(substr(part, 2 * k + 1, {2 * LENGTH})) AS p
    FROM (SELECT doc_id, first, part, unnest(range(0, length(part) // 2 - {LENGTH - 1})) AS k FROM blocks)
), repeated AS (
    SELECT p FROM strings GROUP BY p HAVING count(*) > 1
), marked AS (
    SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {LENGTH}, true) AS new FROM strings JOIN repeated USING (p)
), numbered AS (
    SELECT doc_id, k, sum(new::int) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked
), runs AS (
    SELECT doc_id, min(k) AS a, max(k) + {LENGTH} AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM runs
), cut AS (
    SELECT doc_id, sum(b - a)::bigint AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
