"""Repair of conversation structure: the cheapest edits after which the roles
read system (once, or not) and then user and assistant in turn.

Method: Knuth's lightest derivation.  An item (i, q) says that the first i rows
are settled and the roles so far end in state q; its weight is (cost, audit),
the audit being the edits' initials.  Deductions are the edits: keep, give
another role, delete, insert.  Each adds to the cost and appends a letter, so a
conclusion is never lighter than its premise and, of two derivations of an item,
the lighter stays so (they differ before either ends, as only inserted rows
take no row and these cost).  An agenda pops items by weight; the first goal
item popped is the answer.

Conversations are dealt by id and worked on one after another.  One of more than
``ROWS`` rows or ``BYTES`` of text is cut into segments of ``ROWS`` rows over
many tasks: its rows get their places and repeats by ranks, each segment's
lightest derivations from every state to every state come from the same agenda,
and one short pass adds the segments up in order.  Only the digest of the
repaired text, sequential by its definition, is made in one task then, in a
stream that holds a row at a time.

Faults, the first that holds counts: blank (no visible character), duplicate
(role and text seen earlier in the conversation), truncated (the last visible
character is none of ``.!?``).  Blank and duplicate rows must be deleted, a
truncated one that stays costs 1.  A role is judged by its first character; an
empty role has none and cannot stay.  Null roles and texts are one blank; a null
conv_id is a conversation, null turns come first.  Rows of one turn come by the
digest of role and text, so repeated rows are neighbours.  An empty table has no
rows.  Other columns are ignored, under any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import ranked
from .common import SPACE, column, lean, load, written
from .merkle import CRC_TABLE, crc32_sql

ROWS = 2048
BYTES = 32_000_000
RERUN, DROP, INSERT, CUT = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}

#: States: nothing yet, after system, after user, after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, GOALS = (0, 1, 2, 3), (0, 3)

Row = tuple[str, bool, bool]  # initial of the role, must go, truncated
Weight = tuple[int, str]


def _step(q: int) -> tuple[str, int]:
    """The role that user or assistant can only be in a state, and the next state."""
    c = "a" if q == 2 else "u"
    return c, NEXT[q, c]


def lightest(rows: list[Row], start: int, goals: Iterable[int]) -> dict[int, Weight]:
    """The lightest derivation from ``start`` before the first row to each of the
    states ``goals`` after the last."""
    final: dict[tuple[int, int], Weight] = {}
    missing, n = set(goals), len(rows)
    agenda = [(0, "", 0, start)]
    while agenda and missing:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, audit
        if i == n:
            missing.discard(q)
        _, after = _step(q)
        found = [(cost + INSERT, audit + "I", i, after)]
        if i < n:
            initial, gone, cut = rows[i]
            found.append((cost + DROP, audit + "D", i + 1, q))
            if not gone:
                if (kept := NEXT.get((q, initial))) is not None:
                    found.append((cost + CUT * cut, audit + "K", i + 1, kept))
                found.append((cost + RERUN + CUT * cut, audit + "R", i + 1, after))
        for item in found:
            if item[2:] not in final:
                heapq.heappush(agenda, item)
    return {q: final[n, q] for q in goals if (n, q) in final}


def added(before: dict[int, Weight], spans: dict[tuple[int, int], Weight]) -> dict[int, tuple[Weight, int]]:
    """Weights after one more segment, with the state it is entered in."""
    out: dict[int, tuple[Weight, int]] = {}
    for (p, q), (cost, audit) in spans.items():
        if p in before:
            w = before[p][0] + cost, before[p][1] + audit
            if q not in out or w < out[q][0]:
                out[q] = w, p
    return out


def applied(audit: str, q: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of the rows that an audit makes of others, from state ``q``."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            q = NEXT[q, role[:1]]
        else:
            c, q = _step(q)
            role = NAMES[c]
        yield role, text, edit


# rows


def _rows(df: DataFrame) -> DataFrame:
    """key (of the conversation, null apart), conv_id, turn, role, text and seen,
    the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = df.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return out.withColumn("seen", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _long(rows: DataFrame) -> DataFrame:
    """Keys of the conversations that are cut into segments."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).filter((F.col("n") > ROWS) | (F.col("b") > BYTES)).select("key")


def _stream(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows of sorted batches: the values of ``by``, and of ``names``."""
    key, held = None, []
    for b in batches:
        for values in zip(*(column(b, c).to_pylist() for c in (*by, *names)), strict=True):
            if values[: len(by)] != key:
                if key is not None:
                    yield key, held
                key, held = values[: len(by)], []
            held.append(values[len(by) :])
    if key is not None:
        yield key, held


class _Faults:
    """Counts over rows in order: of the whole conversation, or of a segment
    whose ends ``join`` lets meet."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first: str | None = None
        self.last: str | None = None
        self.turns: list[int] = []  # least, greatest, how many
        self.rows: list[Row] = []

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        end = text.rstrip(SPACE)[-1:]
        fault = 0 if not end else 1 if again else 2 if end not in ".!?" else None
        if fault is not None:
            self.counts[fault] += 1
        self.rows.append((role[:1], fault in (0, 1), fault == 2))
        self.meet(role[:1])
        self.last = role[:1]
        if self.first is None:
            self.first = role[:1]
        if turn is not None:
            self.spread(turn, turn, 1)

    def meet(self, initial: str) -> None:
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts[3] += 1

    def spread(self, low: int, high: int, n: int) -> None:
        """Turns come in order: one that is the greatest so far is not new."""
        if self.turns:
            self.turns = [self.turns[0], high, self.turns[2] + n - (self.turns[1] == low)]
        else:
            self.turns = [low, high, n]

    def join(self, counts: list[int], first: str, last: str, turns: list[int]) -> None:
        self.meet(first)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.last = last
        if turns:
            self.spread(*turns)

    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(df_schema, names: list[tuple[str, object]]) -> pa.Schema:
    return pa.schema([pa.field(n, to_arrow_type(df_schema[n].dataType) if k is None else k) for n, k in names])


def _digest(rows: Iterable[tuple[str, str]]) -> str:
    sha, between = hashlib.sha256(), b""
    for role, text in rows:
        sha.update(between)
        sha.update(f"{role}:{text}".encode())
        between = b"\n"
    return sha.hexdigest()


def _short(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that a task holds: their report, or the repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ints, words = pa.int64(), pa.string()
    schema = _arrow(rows.schema, [("conv_id", None), *((("place", ints), ("role", words), ("text", words), ("edit", words)) if texts else ((c.split()[0], words if c.endswith("string") else ints) for c in REPORT.split(", ")))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, group in _stream(batches, ("key",), ("conv_id", "turn", "role", "text", "seen")):
            faults, met = _Faults(), set()
            for _, turn, role, text, seen in group:
                faults.add(turn, role, text, seen in met)
                met.add(seen)
            best = lightest(faults.rows, 0, GOALS)
            cost, audit = min(best.values())
            repaired = list(applied(audit, 0, ((role, text) for _, _, role, text, _ in group)))
            size += sum(len(r[3]) for r in group)
            if texts:
                out += [(group[0][0], k, *r) for k, r in enumerate(repaired)]
            else:
                out.append((group[0][0], faults.gaps(), *faults.counts, cost, audit, _digest(r[:2] for r in repaired)))
            if len(out) >= ROWS or (texts and size > BYTES):
                yield _table(out, schema)
                out, size = [], 0
        if out:
            yield _table(out, schema)

    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "seen")
    return dealt.mapInArrow(run, f"conv_id {kind}, " + ("place long, role string, text string, edit string" if texts else REPORT))


# conversations in segments

_SEGMENT = "key string, seg long, spans array<struct<p: int, q: int, cost: long, audit: string>>, counts array<long>, first string, last string, turns array<long>"


@lean
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints, words = pa.int64(), pa.string()
    span = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", ints), ("audit", words)])
    schema = pa.schema([("key", words), ("seg", ints), ("spans", pa.list_(span)), ("counts", pa.list_(ints)), ("first", words), ("last", words), ("turns", pa.list_(ints))])
    for (key, seg), group in _stream(batches, ("key", "seg"), ("turn", "role", "text", "again")):
        faults = _Faults()
        for turn, role, text, again in group:
            faults.add(turn, role, text, bool(again))
        spans = [{"p": p, "q": q, "cost": cost, "audit": audit} for p in STATES for q, (cost, audit) in lightest(faults.rows, p, STATES).items()]
        yield _table([(key, seg, spans, faults.counts, faults.first, faults.last, faults.turns)], schema)


_PIECE = "key string, seg long, q int, audit string, gaps long, counts array<long>, cost long"


@lean
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment (its state and part of the audit), and one with
    seg null for the conversation."""
    ints, words = pa.int64(), pa.string()
    schema = pa.schema([("key", words), ("seg", ints), ("q", pa.int32()), ("audit", words), ("gaps", ints), ("counts", pa.list_(ints)), ("cost", ints)])
    for (key,), group in _stream(batches, ("key",), ("seg", "spans", "counts", "first", "last", "turns")):
        faults, best, chosen = _Faults(), {0: (0, "")}, []
        for _, spans, counts, first, last, turns in group:
            faults.join(counts, first, last, turns)
            by = {(s["p"], s["q"]): (s["cost"], s["audit"]) for s in spans}
            after = added(best, by)
            chosen.append({q: (p, by[p, q][1]) for q, (_, p) in after.items()})
            best = {q: w for q, (w, _) in after.items()}
        (cost, audit), q = min((best[q], q) for q in GOALS if q in best)
        out = [(key, None, None, audit, faults.gaps(), faults.counts, cost)]
        for (seg, *_), step in zip(reversed(group), reversed(chosen), strict=True):
            q, piece = step[q]
            out.append((key, seg, q, piece, None, None, None))
        yield _table(out, schema)


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For long conversations: the pieces of ``_added``, and the repaired rows
    (key, conv_id, place, role, text, edit)."""
    placed = written(ranked(rows, [F.col("turn").asc_nulls_first(), F.col("seen")], "pos", by=("key",)), "conversations-placed")
    repeats = ranked(placed.select("key", "seen", "pos"), [F.col("pos")], "again", by=("key", "seen")).filter("again > 0").select("key", "pos", F.lit(True).alias("again"))
    own = written(placed.join(repeats, ["key", "pos"], "left").withColumn("seg", F.floor(F.col("pos") / ROWS)), "conversations-rows")
    of = lambda df: df.repartition("key", "seg").sortWithinPartitions("key", "seg", "pos")
    spans = written(of(own).mapInArrow(_spans, _SEGMENT), "conversations-spans")
    pieces = written(spans.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_added, _PIECE), "conversations-pieces")
    kind, words = rows.schema["conv_id"].dataType.simpleString(), pa.string()
    schema = _arrow(rows.schema, [("key", words), ("conv_id", None), ("place", pa.int64()), ("role", words), ("text", words), ("edit", words)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, seg), group in _stream(batches, ("key", "seg"), ("conv_id", "role", "text", "q", "audit")):
            _, _, _, q, audit = group[0]
            made = applied(audit, q, ((role, text) for _, role, text, _, _ in group[1:]))
            out = [(key, group[1][0], seg << 32 | k, *r) for k, r in enumerate(made)]
            if out:
                yield _table(out, schema)

    none = lambda c, k: F.lit(None).cast(k).alias(c)
    sent = pieces.filter("seg IS NOT NULL").select("key", "seg", F.lit(-1).cast("long").alias("pos"), none("conv_id", kind), none("role", "string"), none("text", "string"), "q", "audit")
    both = own.select("key", "seg", "pos", "conv_id", "role", "text", none("q", "int"), none("audit", "string")).unionByName(sent)
    return pieces, of(both).mapInArrow(run, f"key string, conv_id {kind}, place long, role string, text string, edit string")


def _cut_report(rows: DataFrame) -> DataFrame:
    pieces, repaired = _cut(rows)
    schema = pa.schema([("key", pa.string()), ("sha", pa.string())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            for k, role, text in zip(*(column(b, c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if k != key:
                    if sha is not None:
                        yield _table([(key, sha.hexdigest())], schema)
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield _table([(key, sha.hexdigest())], schema)

    shas = repaired.select("key", "place", "role", "text").repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, "key string, sha string")
    count = lambda k, c: F.col("counts")[k].alias(c)
    whole = pieces.filter("seg IS NULL").select("key", "gaps", *(count(k, c) for k, c in enumerate(("blank", "duplicate", "truncated", "illegal"))), "cost", "audit")
    ids = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(whole, "key").join(shas, "key", "left")
    return out.withColumn("repaired_sha256", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))).drop("key", "sha")


def _by_size(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task holds, and of the others (None: none)."""
    rows = _rows(df)
    long = written(_long(rows), "conversations-long")
    if long.isEmpty():
        return rows, None
    return rows.join(long, "key", "left_anti"), rows.join(long, "key", "left_semi")


def repair(df: DataFrame) -> DataFrame:
    """The repaired rows of conversations (conv_id, turn, role, text): conv_id,
    place (orders the rows of a conversation), role, text, and edit (``K`` kept,
    ``R`` with another role, ``I`` inserted)."""
    short, long = _by_size(df)
    out = _short(short, True)
    return out if long is None else out.unionByName(_cut(long)[1].drop("key"))


def report(df: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps in its turns, blank, duplicate
    and truncated rows, illegal neighbours, cost and audit of the cheapest repair
    (ties: the least audit), and the SHA-256 of the repaired ``role:text`` lines."""
    short, long = _by_size(df)
    out = _short(short, False)
    return out if long is None else out.unionByName(_cut_report(long))


def damaged(df: DataFrame) -> DataFrame:
    """Rows with planted faults by the CRC-32 of ``conv_id:turn`` (nulls: one
    blank) modulo 20: 0 dropped, 1 text empty, 2 without ``.!?``, 3 twice, 4 user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(k == 0, F.array().cast("array<int>")).when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select("conv_id", "turn", F.when(k == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    found = report(damaged(rows))
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    none = {c.split()[0]: F.coalesce(c.split()[0], F.lit(0).cast("long")) for c in REPORT.split(", ") if c.endswith("long")}
    return out.select(F.col("id").alias("conv_id"), *(c.alias(n) for n, c in none.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_INSERTS = ", ".join(f"({q}, {r}, {2 * k}, '{'I' * k}')" for q in STATES for k, r in enumerate((q, _step(q)[1], _step(_step(q)[1])[1])))
_MOVES = ", ".join(f"({q}, '{c}', {r})" for (q, c), r in NEXT.items())
OP12_SQL = f"""WITH RECURSIVE crc AS {CRC_TABLE},
source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source s JOIN ids ON s.conv_id IS NOT DISTINCT FROM ids.conv_id, (VALUES (1), (2)) n(n) WHERE k <> 0 AND (n = 1 OR k = 3)),
digests AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS h, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS e FROM damaged),
placed AS (SELECT *, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prev FROM digests WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, h)),
faults AS (SELECT *, CASE WHEN e = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM (SELECT *, row_number() OVER (PARTITION BY c, h ORDER BY i) AS seen FROM placed)),
counts AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
  count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
inserts AS (SELECT * FROM (VALUES {_INSERTS}) t(q, r, w, a)), moves AS (SELECT * FROM (VALUES {_MOVES}) t(q, x, r)),
edits AS (SELECT q, '' AS x, q AS r, 3 AS w, 'D' AS a FROM (VALUES (0), (1), (2), (3)) s(q) UNION ALL SELECT q, x, r, 0, 'K' FROM moves UNION ALL SELECT q, x, r, 2, 'R' FROM moves WHERE x <> 's'),
best AS (SELECT c, CAST(0 AS BIGINT) AS i, 0 AS q, '000000000' AS v FROM counts
  UNION ALL SELECT b.c, b.i + 1, e.r, min(lpad(CAST(CAST(left(b.v, 9) AS BIGINT) + t.w + e.w + (CASE WHEN e.a <> 'D' AND f.f = 3 THEN 1 ELSE 0 END) AS VARCHAR), 9, '0') || substr(b.v, 10) || t.a || e.a)
  FROM best b JOIN faults f ON b.c = f.c AND f.i = b.i + 1 JOIN inserts t ON t.q = b.q JOIN edits e ON e.q = t.r AND (e.a = 'D' OR f.f NOT IN (1, 2) AND (e.a = 'R' OR e.x = f.ini)) GROUP BY b.c, b.i, e.r),
ends AS (SELECT b.c, min(lpad(CAST(CAST(left(b.v, 9) AS BIGINT) + t.w AS VARCHAR), 9, '0') || substr(b.v, 10) || t.a) AS v FROM best b JOIN counts n ON b.c = n.c AND b.i = n.n JOIN inserts t ON t.q = b.q WHERE t.r IN (0, 3) GROUP BY b.c),
letters AS (SELECT c, p, x, count(*) FILTER (WHERE x <> 'I') OVER w AS i, count(*) FILTER (WHERE x <> 'D') OVER w AS m, count(*) FILTER (WHERE x <> 'D') OVER (PARTITION BY c) AS n
  FROM (SELECT c, unnest(range(1, length(v) - 8)) AS p, substr(v, CAST(9 + unnest(range(1, length(v) - 8)) AS BIGINT), 1) AS x FROM ends) WINDOW w AS (PARTITION BY c ORDER BY p)),
repaired AS (SELECT l.c, string_agg((CASE WHEN x = 'K' THEN f.role WHEN (m - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN x = 'I' THEN '' ELSE f.text END), chr(10) ORDER BY p) AS t
  FROM letters l LEFT JOIN faults f ON l.c = f.c AND l.i = f.i WHERE x <> 'D' GROUP BY l.c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(v, 9) AS BIGINT), 0) AS cost, coalesce(substr(v, 10), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON ids.c = counts.c LEFT JOIN ends ON ids.c = ends.c LEFT JOIN repaired ON ids.c = repaired.c"""
