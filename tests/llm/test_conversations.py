"""Repairs against all edit sequences of small conversations, and against SQL."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meshwork.llm import conversations as C

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def order(rows):
    key = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, key(r)))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = VISIBLE.findall(text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every(rows, kinds):
    """The least (cost, audit) among all edit sequences with up to two inserts in
    a row, and what it makes."""
    best, limit = None, -1

    def walk(i, inserted, cost, audit, made):
        nonlocal best
        if cost > limit:
            return
        if i == len(rows):
            roles = "".join(r[:1] for r, _ in made)
            if GOAL.fullmatch(roles):
                best = min(best or (cost, audit, made), (cost, audit, made), key=lambda x: x[:2])
        if inserted < 2:
            for r in ("user", "assistant"):
                walk(i, inserted + 1, cost + 2, audit + "I", [*made, (r, "")])
        if i < len(rows):
            _, _, role, text = rows[i]
            cut = kinds[i] == "truncated"
            if kinds[i] not in ("blank", "duplicate"):
                if role:  # an empty one cannot stay
                    walk(i + 1, 0, cost + cut, audit + "K", [*made, (role, text)])
                for r in ("user", "assistant"):
                    walk(i + 1, 0, cost + 2 + cut, audit + "R", [*made, (r, text)])
            walk(i + 1, 0, cost + 3, audit + "D", made)

    while best is None:  # costs from the least on
        limit += 1
        walk(0, 0, 0, "", [])
    return best


def brute(rows):
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = order([r for r in after if r[0] == conv])
        kinds = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, made = every(own, kinds)
        said = "\n".join(f"{r}:{t}" for r, t in made)
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, tmp=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp}/conversations.parquet")
    return sorted(map(tuple, C.op12_conversations(spark, str(tmp)).collect()), key=str)


def talk(rnd, conv, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hi.", "No", "  \t", "Yes! ", "é?", "", None, "a\nb.", "More.", "Less?"]
    return [(conv, rnd.choice([k, k, k, None, k + 3]), rnd.choices(roles, [5, 5, 2, 1, 1, 1])[0], rnd.choice(texts)) for k in range(n)]


def test_equals_all_edit_sequences(spark, tmp_path):
    rnd = random.Random(7)
    rows = [r for c in range(80) for r in talk(rnd, c if c else None, rnd.randrange(1, 5))]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    """Segments over many tasks give what one task gives."""
    rnd = random.Random(3)
    rows = [(c, k, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Hi.", f"Line {k}", f"Text {k}!", f"T{k % 50}?", " "])) for c, n in ((1, 5000), (2, 40), (None, 2500)) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut = sorted(map(tuple, C.report(df).collect()), key=str)
    texts = {c: [tuple(r)[2:] for r in C.repair(df).filter(F.col("conv_id").eqNullSafe(c)).orderBy("place").collect()] for c in (1, 2, None)}
    monkeypatch.setattr(C, "_long", lambda rows: rows.select("key").limit(0))
    assert cut == sorted(map(tuple, C.report(df).collect()), key=str) and len(cut) == 3
    for c in (1, 2, None):
        assert texts[c] == [tuple(r)[2:] for r in C.repair(df).filter(F.col("conv_id").eqNullSafe(c)).orderBy("place").collect()]
        assert GOAL.fullmatch("".join(r[0][0] for r in texts[c]))


def test_one_conversation_of_equal_rows(spark):
    df = spark.range(6000).selectExpr("7L AS conv_id", "CAST(NULL AS BIGINT) AS turn", "'user' AS role", "'Same.' AS text")
    (row,) = C.report(df).collect()
    assert (row["duplicate"], row["gaps"], row["cost"], row["audit"][:2], len(row["audit"])) == (5999, 0, 3 * 5999 + 2, "KD", 6001)


def test_weights_of_derivations():
    rnd = random.Random(1)
    for _ in range(200):
        rows = [(rnd.choice("suat"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(8))]
        got = C.lightest(rows, 0, C.GOALS)
        # segments of any cut add up to the same
        k = rnd.randrange(len(rows) + 1)
        before = {q: w for q, w in C.lightest(rows[:k], 0, C.STATES).items()}
        after = {(p, q): w for p in C.STATES for q, w in C.lightest(rows[k:], p, C.STATES).items()}
        assert {q: w for q, (w, _) in C.added(before, after).items() if q in C.GOALS} == got


def test_empty_table_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.report(empty).count() == 0 and C.repair(empty).count() == 0 and got(spark, [], tmp_path) == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "seen", "pos", "seg", "a.b", "copy", "id")})
    assert [tuple(r) for r in C.report(df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())]


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(C.OP12_SQL).fetchall()
    have = [tuple(r) for r in C.op12_conversations(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(have) == sorted(want)
