import math
import random
import re

from meshwork.llm import pii

from .helpers import empty, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_as_the_patterns():
    rnd = random.Random(3)
    bits = ["1", "25", "300", ".", "@", "a", "-", " ", "+", "(", "4111111111111111", "a.b", "é", "..", "007", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 200_000):
        pii.base_spans(text)


def test_learns_from_contexts(spark):
    phones = [f"please dial +1 (555) 010-{k:04d} today" for k in range(12)]
    unseen = ["please dial ext-55123 today", "please dial 555x0199 today"]
    other = ["a total of 4711 things", "please wait 5 minutes", None, "", "no data at all"]
    got = {r["doc_id"]: r for r in pii.extract(table(spark, phones + unseen + other)).collect()}
    assert all(got[k]["n_phone"] == 1 and got[k]["added"] is None for k in range(12))
    assert [(s["kind"], s["start"], s["end"]) for s in got[12]["added"]] == [("phone", 12, 21)]
    assert [(s["kind"], s["start"], s["end"]) for s in got[13]["added"]] == [("phone", 12, 20)]
    assert all(got[k]["added"] is None for k in range(14, 19))


def test_adjacent_numbers_are_one_instance():
    spans = lambda t: [(t[o["start"] : o["end"]], o["patterns"]) for o in pii.occurrences(t, pii.base_spans(t))]
    assert spans("please dial 555 012 3456 today") == [("555 012 3456", ["dial _", "dial _ today", "please dial _"])]
    assert [x for x, _ in spans("please dial (555) 012-3456 today")] == ["(555) 012-3456"]
    assert [x for x, _ in spans("a room 12, 14 and ext-55123 77 or 5\n6")] == ["12", "ext-55123", "77", "5"]
    assert [x for x, _ in spans("write a@b.c 55 now")] == ["a@b.c", "55"]


def test_learns_numbers_with_blanks(spark):
    rows = [f"please dial +1 (555) 010-{k:04d} today" for k in range(12)] + ["please dial 555 012 3456 today"]
    got = {r["doc_id"]: r["added"] for r in pii.extract(table(spark, rows)).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[12]] == [("phone", 12, 24)]


def graph(texts):
    """The added spans by the definition, in plain Python."""
    occ = [(k, o) for k, t in enumerate(texts) for o in pii.occurrences(t or "", pii.base_spans(t or ""))]
    stands = {}
    for _, o in occ:
        for p in o["patterns"]:
            stands.setdefault(p, set()).add(o["instance"])
    seeds = {(o["instance"], o["kind"]): 1.0 for _, o in occ if o["kind"]}
    known, now = {i for i, _ in seeds}, dict(seeds)
    for _ in range(pii.ROUNDS):
        trusted = {}
        for p, inside in stands.items():
            for kind in (*pii.KINDS, pii.SECRET):
                good = [now[i, kind] for i in inside if now.get((i, kind), 0) >= pii.ACCEPT]
                if len(good) >= pii.MIN_SEEDS and sum(good) / (len(inside) + 1) >= pii.TRUST:
                    trusted[p, kind] = sum(good) / (len(inside) + 1)
        now = dict(seeds)
        for i in {i for inside in stands.values() for i in inside} - known:
            for kind in (*pii.KINDS, pii.SECRET):
                missed = [1 - c for (p, k), c in trusted.items() if k == kind and i in stands[p]]
                if missed:
                    now[i, kind] = 1 - math.prod(missed)
    out = {}
    for doc, o in occ:
        if o["kind"] in (None, pii.SECRET):
            kinds = {(now[o["instance"], k], k) for p in o["patterns"] for q, k in trusted if q == p and now.get((o["instance"], k), 0) >= pii.ACCEPT}
            if kinds:
                out.setdefault(doc, []).append((max(kinds)[1], o["start"], o["end"]))
    return {doc: sorted(spans) for doc, spans in out.items()}


def test_added_spans_as_the_graph_says(spark):
    rnd = random.Random(9)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    made = {
        "call": lambda: f"+1 (555) 010-{rnd.randrange(10000):04d}", "from": lambda: f"u{rnd.randrange(999)}@mail.example", "host": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        "token =": lambda: f'"{key(40)}"', "about": lambda: str(rnd.randrange(900)), "paid with": lambda: "4111 1111 1111 1111",
    }
    texts = []
    for _ in range(300):
        word = rnd.choice(list(made))
        what = made[word]() if rnd.random() < 0.85 else rnd.choice([f"x{rnd.randrange(99)}-{key(6)}", f"node{rnd.randrange(50)}", "555 0199 12"])
        texts.append(f"{rnd.choice(['so', 'then', 'now we'])} {word} {rnd.choice(['', '| ', '- '])}{what} {rnd.choice(['again', 'for one', '.'])}")
    texts += [None, "", *texts[:20]]
    want = graph(texts)
    got = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.extract(table(spark, texts)).filter("added IS NOT NULL").collect()}
    assert got == want and {k for spans in want.values() for k, _, _ in spans} >= {"secret", "phone", "email", "ip"}


def test_planted_contexts(spark):
    """Unseen identifiers in contexts of seeds, and as many numbers elsewhere:
    recall and precision."""
    rnd = random.Random(4)
    seeds = [f"{rnd.choice(['Tel:', 'tel', 'TEL ='])} +49 (30) {rnd.randrange(10**6, 10**7)} {w}" for w in "abcdefghijklmnopqrst"]
    unseen = [f"{w} tel: 030/{rnd.randrange(10**6)}-{k}" for k, w in enumerate("abcdefghij")]
    other = [f"{w} room {rnd.randrange(1000)}" for w in "abcdefghij"] + ["commit 3b18e512dba79e4c8300dd08aeb37f8e728b8dad of the tree"]
    got = {r["doc_id"] for r in pii.extract(table(spark, seeds + unseen + other)).filter("added IS NOT NULL").collect()}
    assert got == set(range(20, 30))


def test_far_context_and_secrets(spark):
    far = ["token" + " |" * 400 + f' "{k:040x}"' for k in range(7, 12)]
    rows = pii.op_spans(pii.extract(table(spark, [*far, 'Token: "key-77x"', "a" * 300 + " 4711 b"])))
    got = {r["doc_id"]: (r["spans"], r["n_added"], r["n_spans"], r["n_card"]) for r in rows.collect()}
    assert got[0] == ("secret:807:847", 1, 1, 0)
    assert got[5] == ("secret:8:15", 1, 1, 0) and got[6] == ("", 0, 0, 0)


def test_copies_give_no_confidence(spark):
    rows = ["please dial +1 (555) 010-0001 today"] * 30 + ["please dial ext-55123 today"]
    assert pii.extract(table(spark, rows)).filter("added IS NOT NULL").count() == 0


def test_edges(spark):
    assert pii.extract(empty(spark)).count() == 0
    rows = pii.extract(table(spark, ["a@b.c", "a@b.c", "1.2.3.4"], ids=[1, 1, 1])).collect()
    assert sorted(r["base"] for r in rows) == ["email:0:5", "email:0:5", "ip:0:7"]
