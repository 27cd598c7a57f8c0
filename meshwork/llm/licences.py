"""License scans: what licence a file states, or inherits from a directory.

Method: sparse TF-IDF cosine to templates.  Every line of a file, the whole and,
over the words of the whole, lines joined, every run of a template's length and
of half as many words more are compared with each template over the templates'
terms; inverse document frequencies are counted over all files, and words that
no template has weigh as the rarest.  A run within other words needs two of the
template's telling words (``marks``).  Sums over the words bound the similarity
of all runs at once, so that only runs that can reach ``LEAST`` are compared in
full.  A licence file (by its name, or because the statement
is at least ``SHARE`` of its words) gives its directory a licence: the most
similar one, then the first path.  A file without a statement of its own
inherits from the nearest ancestor directory that has one; that is found for
directories, not files, by joining them with the paths above them.

A null text has no words, a null path no directory: such a file states and
inherits nothing.  Files with equal paths are separate.  An empty table gives an
empty result.  Other columns are carried; those named like a computed one are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, column, lean, load, unboxed, written

LEAST, SHARE = 0.5, 0.3
CELLS = 1_000_000  # pairs of words that are compared at once
#: The whole texts of short licences.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: The usual statements of common licences.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", _BSD),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", _ISC),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", _MIT),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}
_WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
_NAME = r"(?i)^(un)?(licen[sc]e|copying|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})


class Scanner:
    """Templates as sparse vectors, by inverse document frequency."""

    def __init__(self, files: int, found: dict[str, int]):
        self.rarest = math.log(1 + files) + 1
        self.idf = {t: math.log((1 + files) / (1 + found.get(t, 0))) + 1 for t in VOCABULARY}
        self.templates = []
        for name, texts in TEMPLATES.items():
            for x in texts:
                v = {t: n * self.idf[t] for t, n in Counter(terms(x)).items()}
                self.templates.append((name, v, math.sqrt(sum(w * w for w in v.values())), len(terms(x))))
        # a text like a template has a term that carries a share of its weight
        self.marks = {t for _, v, norm, _ in self.templates for t, w in v.items() if w / norm >= LEAST / math.sqrt(len(v))}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        counts = Counter(words)
        mine = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        if not any(t in self.marks for t in mine):
            return 0.0, None
        norm = math.sqrt(sum(w * w for w in mine.values()) + sum((n * self.rarest) ** 2 for t, n in counts.items() if t not in self.idf))
        scored = [(sum(w * v.get(t, 0.0) for t, w in mine.items()) / (norm * size), name) for name, v, size, _ in self.templates]
        top = max(s for s, _ in scored)
        return top, min(n for s, n in scored if s == top)

    def windows(self, words: list[str]) -> tuple[float, str | None, int]:
        """The most similar run of about as many words as a template has:
        similarity, licence and length."""
        best, seen = (0.0, None, 0), set(words)
        some = [x for x in self.templates if sum(w * w for t, w in x[1].items() if t in seen) >= (LEAST * x[2]) ** 2]
        if not some:
            return best
        ids: dict[str, int] = {}
        codes = np.array([ids.setdefault(t, len(ids)) for t in words])
        weight = np.array([self.idf.get(t, self.rarest) for t in ids])
        squares = np.concatenate([[0.0], np.cumsum(weight[codes] ** 2)])
        for name, v, size, n in some:
            dots = np.concatenate([[0.0], np.cumsum((np.array([v.get(t, 0.0) for t in ids]) * weight)[codes])])
            telling = [k for t, k in ids.items() if t in v and t in self.marks]
            for length in (n, n + n // 2):
                if length >= len(words):
                    continue
                dot, square = dots[length:] - dots[:-length], squares[length:] - squares[:-length]
                # a word that a run repeats only lowers its similarity
                can = np.flatnonzero((dot >= (LEAST - 1e-9) * size * np.sqrt(square)) & (dot > 0))
                step = max(1, CELLS // length**2)
                for a in range(0, len(can), step):
                    at = can[a : a + step]
                    run = codes[at[:, None] + np.arange(length)]
                    norm = np.sqrt(((weight[run] ** 2)[:, :, None] * (run[:, :, None] == run[:, None, :])).sum(axis=(1, 2)))
                    told = sum(((run == k).any(axis=1).astype(int) for k in telling), np.zeros(len(run), int)) > 1
                    top = round(float(np.where(told, dot[at] / (norm * size), 0.0).max()), 9)
                    if (top, length) > (best[0], best[2]) or ((top, length) == (best[0], best[2]) and name < (best[1] or name)):
                        best = (top, name, length)
        return best

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """Licence, similarity, and the statement's share of the words."""
        lines = [terms(x) for x in text.split("\n")]
        words = [t for x in lines for t in x]
        tries = [(*self.best(x), len(x)) for x in lines if x]
        if len(lines) > 1:
            tries.append((*self.best(words), len(words)))
        score, name, size = max([*tries, self.windows(words)], key=lambda x: (round(x[0], 9), x[2]))
        return (name, round(score, 6), size / len(words)) if name and score >= LEAST else (None, 0.0, 0.0)


def _frequencies(files: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Files, and files with each of the templates' terms."""
    known = set(VOCABULARY)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for x in column(batch, text):
                c.update(known.intersection(terms(x.as_py() or "")))
            names = [*c, ""]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*c.values(), batch.num_rows], pa.int64())], names=["term", "n"])

    rows = files.select(text).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the templates
    found = {r["term"]: r["n"] for r in rows}
    return found.pop("", 0), found


MADE = ("own_licence", "similarity", "licence_file", "licence", "inherited_from")


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` without ``text``, with own_licence, similarity, licence_file,
    licence (its own or the inherited) and inherited_from (a directory).  Other
    columns are carried under any name; those of these names are replaced."""
    out = _scanned(boxed(files, path, text).toDF("path", "text", "__box")).withColumnRenamed("path", path)
    return unboxed(out, [c for c in files.columns if c != text], (path,), {c: F.col(c) for c in MADE})


def _scanned(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    spark = files.sparkSession
    scanner = spark.sparkContext.broadcast(Scanner(*_frequencies(files, text)))
    carried = [f for f in files.schema.fields if f.name != text]
    schema = T.StructType([*carried, T.StructField("own_licence", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("share", T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner.value
        for batch in batches:
            got = [s.scan(x.as_py() or "") for x in column(batch, text)]
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in carried), *(pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64()), strict=True))], names=schema.names)

    at = F.col(path)
    rows = files.select(*(f.name for f in carried), text).mapInArrow(run, schema)
    by_name = F.coalesce(F.regexp_extract(at, r"([^/]*)$", 1).rlike(_NAME), F.lit(False))
    rows = rows.withColumn("licence_file", F.col("own_licence").isNotNull() & (by_name | (F.col("share") >= SHARE)))
    rows = written(rows.withColumn("__dir", F.when(at.isNotNull(), F.regexp_replace(at, r"/?[^/]*$", ""))).drop("share"), "licence-files")
    # directories: their own licence, and the nearest one above
    own = rows.filter("licence_file").groupBy("__dir").agg(F.min_by("own_licence", F.struct(-F.col("similarity"), at, F.col("own_licence"))).alias("dir_licence"))
    dirs = rows.filter("__dir IS NOT NULL").select("__dir").distinct()
    parts = F.filter(F.split("__dir", "/"), lambda p: p != "")
    rooted = F.when(F.startswith("__dir", F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    above = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.when(k == F.size(parts), F.col("__dir")).otherwise(F.concat(rooted, F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up")))).alias("a")).select("__dir", "a.*")
    near = above.join(own.withColumnRenamed("__dir", "up"), "up").groupBy("__dir").agg(F.max_by(F.struct("up", "dir_licence"), "depth").alias("near"))
    near = written(near.select("__dir", F.col("near.up").alias("__up"), F.col("near.dir_licence").alias("__licence")), "licence-dirs")
    out = rows.join(near, "__dir", "left")
    inherits = F.col("own_licence").isNull()
    return out.select(*(f.name for f in carried), "own_licence", "similarity", "licence_file", F.coalesce("own_licence", "__licence").alias("licence"), F.when(inherits, F.col("__up")).alias("inherited_from"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then language."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    return scan(load(spark, sf_dir).select("doc_id", path.alias("path"), "text"))
