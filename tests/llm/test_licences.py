import math
import random
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from meshwork.llm import licences

from .helpers import empty

FILES = [
    ("repo/LICENSE", "Released under the MIT License."),
    ("repo/a/x.py", "print(1)\n" * 30),
    ("repo/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("repo/a/b/c/y.py", "no statement here"),
    ("repo/a/b/z.py", "# Licensed under the Apache License, Version 2.0.\nimport os\n" + "work = 1\n" * 50),
    ("other/w.py", "a table that someone reserved, and a person who has the key to it"),
    ("top.txt", None),
    (None, "All rights reserved."),
    ("repo/a/x.py", ""),
]


def test_statements_and_inheritance(spark):
    df = spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate(FILES)], "path string, text string, similarity long").repartition(3)
    got = {(r["path"], r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.scan(df).collect()}
    assert got == {
        ("repo/LICENSE", "mit", "mit", None),
        ("repo/a/x.py", None, "mit", "repo"),
        ("repo/a/b/COPYING", "gpl-3.0", "gpl-3.0", None),
        ("repo/a/b/c/y.py", None, "gpl-3.0", "repo/a/b"),
        ("repo/a/b/z.py", "apache-2.0", "apache-2.0", None),
        ("other/w.py", None, None, None),
        ("top.txt", None, None, None),
        (None, "all-rights-reserved", "all-rights-reserved", None),
    }


def test_edges(spark):
    assert licences.scan(empty(spark).withColumnRenamed("source", "path")).count() == 0


def test_templates_find_themselves():
    s = licences.Scanner(1000, dict.fromkeys(("the", "of", "and", "to", "in", "is", "a"), 900))
    for name, texts in licences.TEMPLATES.items():
        for t in texts:
            assert s.scan("first line of a file\n" + t + "\nlast line")[0] == name


def test_statements_among_other_words():
    common = dict.fromkeys(("the", "of", "and", "to", "in", "is", "a", "this", "by"), 900)
    s = licences.Scanner(1000, common)
    filler = " ".join(f"w{k}" for k in range(4000))
    for text, name in (
        ("Copyright 2024 Jane Doe. Released under the MIT License.", "mit"),
        ("This file is part of the example tool and is released under the MIT License.", "mit"),
        ("Photos by Jane Doe and John Roe, licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ):
        assert s.scan(text)[:2] == (name, 1.0)
        assert s.scan(f"{filler} {text} {filler}")[:2] == (name, 1.0)
        # over line ends, far down in a long file
        assert s.scan("work = 1\n" * 2000 + text.replace(" ", "\n") + "\n" + filler)[:2] == (name, 1.0)
    for text in ("one of the reserved seats", "a person who has the licensed key", filler):
        assert s.scan(f"{filler} {text} {filler}") == (None, 0.0, 0.0)


def test_windows_as_one_by_one():
    s = licences.Scanner(1000, dict.fromkeys(("the", "of", "and", "to", "in", "is", "a"), 900))
    rnd = random.Random(4)
    bits = licences.terms("released under the mit license all rights reserved of work licensed cc by 4.0 x y z")
    for _ in range(150):
        words = [rnd.choice(bits) for _ in range(rnd.randint(1, 30))]
        want = 0.0
        for _, v, size, n in s.templates:
            for length in {n, n + n // 2}:
                for a in range(len(words) - length + 1 if length < len(words) else 0):
                    run = Counter(words[a : a + length])
                    if len([t for t in run if t in v and t in s.marks]) > 1:
                        mine = {t: c * s.idf.get(t, s.rarest) for t, c in run.items()}
                        want = max(want, sum(w * v.get(t, 0) for t, w in mine.items()) / (size * math.sqrt(sum(w * w for w in mine.values()))))
        got = s.windows(words)[0]
        assert abs(got - want) < 1e-6 if want >= licences.LEAST else got < licences.LEAST


def test_whole_licence_texts(spark):
    """Whole texts, wrapped, with a copyright line and among other words; nulls, repeated rows and ties."""
    wrap = lambda t: "\n".join(textwrap.wrap(t, 72))
    other = " ".join(f"word{k}" for k in range(4000))
    files = [
        ("a/LICENSE", "Copyright (c) 2024 Jane Doe\n\n" + wrap(licences._MIT)), ("b/COPYING", "Copyright 1999, A. B.\nAll code of this folder:\n" + wrap(licences._BSD)),
        ("c/LICENSE", wrap(licences._ISC)), ("a/x.py", "import os"), ("b/deep/y.py", None), ("c/z.py", other + "\n" + wrap(licences._MIT) + "\n" + other), (None, "no path"), ("c/LICENSE", wrap(licences._ISC)), (None, None),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files)], "id long, path string, text string").withColumns({c: F.lit(c) for c in ("share", "score", "depth", "up")})
    got = {r["id"]: r for r in licences.scan(df.drop("share")).collect()}
    assert [got[k]["licence"] for k in range(9)] == ["mit", "bsd", "isc", "mit", "bsd", "mit", None, "isc", None]
    assert got[3]["inherited_from"] == "a" and got[4]["inherited_from"] == "b" and got[5]["inherited_from"] is None
    assert all(got[k]["depth"] == "depth" for k in range(9))


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("a/LICENSE", "Permission is hereby granted, free of charge, to any person"), ("a/x.py", "code"), (None, None)], "path string, text string")
    wide = df.withColumns({c: F.lit(f"{c}!") for c in ("share", "__dir", "up", "near", "a.b", "__box", "licence")})
    out = licences.scan(wide)
    assert out.columns == ["path", "share", "__dir", "up", "near", "a.b", "__box", *licences.MADE]
    assert out.count() == 3 and out.filter("share <> 'share!' OR __dir <> '__dir!' OR `a.b` <> 'a.b!'").isEmpty()
