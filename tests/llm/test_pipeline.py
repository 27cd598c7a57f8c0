import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from meshwork.llm import bpe
from meshwork.llm.common import written

from .helpers import WORD, babble, empty, lowered, table, words


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    shared = "this very line stands in a good many of the documents here"
    texts = [babble(rnd, rnd.randint(60, 200), 3000) + ("\n" + shared if k % 3 == 0 else "") for k in range(120)]
    texts += [texts[5], texts[5], None, "", "too short", "same words here " * 60]
    docs = table(spark, texts, sources=["a", "a", "b"]).drop("extra")
    names = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, ""), "test")
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        if k == 1:
            assert sum(shared in r["text"] for r in docs.collect()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert counts[:3] == [122, 122, 120] and counts[3] == counts[4]
    assert all(len(r["ids"]) > 0 for r in docs.collect())


def test_empty(spark):
    docs = empty(spark).drop("extra")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "test-empty")
    assert docs.count() == 0


def base_ok(text):
    w = WORD.findall(text or "")
    windows, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            repeated |= {k, k + 1, k + 2}
    return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)


def without_shared_lines(texts):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for k, t in texts.items():
        for x in {key(x) for x in t.split("\n")}:
            held.setdefault(x, []).append(k)
    goes = {x: max(ids) for x, ids in held.items() if len(x) >= 40 and len(ids) >= 5}
    return {k: "\n".join(x for x in t.split("\n") if goes.get(key(x), k) == k) for k, t in texts.items()}


def one_of_each(texts):
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, t in texts.items() if (w := words(t))}
    root = {k: k for k in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {k: t for k, t in texts.items() if root[k] == k}


def test_against_brute_force(spark):
    """All stages after each other: outliers are none here, and the mix takes
    each document as often as its words make up its source's target."""
    rnd = random.Random(21)
    shared = [f"line {k} that is found in many of these documents of the corpus" for k in range(3)]
    texts = [babble(rnd, rnd.randint(60, 160), 5000) + "".join("\n" + x for x in shared if rnd.random() < 0.3) for _ in range(60)]
    for k in range(0, 30, 3):  # near copies: one word of many changed
        w = texts[k].split(" ")
        w[7] = "changed"
        texts.append(" ".join(w))
    texts += [texts[1], None, "", "few words", "again and again and " * 40]
    docs = table(spark, texts, sources=["a", "a", "a", "b"]).drop("extra")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, ""), "test-brute")
    want = one_of_each(without_shared_lines({k: t for k, t in enumerate(texts) if base_ok(t)}))
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    mixed = written(corpus_pipeline.STAGES[3][1](spark, docs, ""), "test-brute")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(want) and max(times.values()) <= 3
    source = {k: "aaab"[k % 4] for k in want}
    size = {s: sum(len(words(t)) for k, t in want.items() if source[k] == s) for s in "ab"}
    target = {"a": 5 / 7 * sum(size.values()), "b": 2 / 7 * sum(size.values())}
    assert all(target[s] <= 3 * size[s] for s in "ab")
    for s in "ab":
        assert abs(sum(n * len(words(want[k])) for k, n in times.items() if source[k] == s) - target[s]) <= 80
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in rows) == times
    assert all(r["ids"] == library.encode(want[r["doc_id"]], add_special_tokens=False).ids for r in rows)
