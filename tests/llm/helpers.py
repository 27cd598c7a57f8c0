"""Small tables and brute-force versions that several tests use."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def table(spark, texts, langs=None, sources=None, ids=None):
    rows = [(k if ids is None else ids[k], t, (langs or ["en"])[k % len(langs or [1])], (sources or ["a", "b", None])[k % len(sources or [1, 2, 3])], len(t or ""), "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return text.encode().lower().decode()


def words(text):
    return WORD.findall(lowered(text or ""))


def babble(rnd, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n))
