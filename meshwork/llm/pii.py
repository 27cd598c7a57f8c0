"""Personal data: fixed patterns, and identifiers learned from their contexts.

Method: bootstrapped contextual extraction.  What the fixed patterns find are
the seeds; long hexadecimal or mixed strings are seeds of a further kind,
``secret``, that no fixed pattern reports.  A seed's lexical patterns are the
word before it, the two words before it, and the word before with the word
after: lower case, without punctuation at their edges, tokens without a letter
or digit skipped.  Tokens with a digit or an @ that no fixed pattern takes,
adjacent numbers as one, are candidate instances of the same patterns.  Spark
scores the graph of patterns and instances in ``ROUNDS`` rounds.  In each, what
is accepted (seeds, and instances that reach ``ACCEPT``) supports patterns: a
pattern counts for a kind once ``MIN_SEEDS`` different accepted instances stand
in it, and its confidence, the sum of their scores over its distinct instances
and one more, reaches ``TRUST``.  An instance's score is the noisy-or of the
patterns that it stands in; seeds keep 1.  After the last round, instances that
reach ``ACCEPT`` are added under their kind wherever they stand in a pattern of
it; secrets too are added only there.  Copies of a document add no new instance,
and so no confidence.

Only documents with a digit or an @ are searched, these whole; the fixed
patterns are written so that no text takes more than linear time.  Null texts
are empty.  Rows with equal ids and texts get the same spans; rows with equal ids
and other texts do not mix.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, lean, load, per_row, pieces, written

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ROUNDS, MIN_SEEDS, TRUST, ACCEPT = 3, 3, 0.6, 0.6
LONGEST = 64  # characters of an instance or a context word; longer ones are hashed

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole, so a start within one finds nothing that its first digit does not.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[0-9()\[\]+./,:;-]++")
#: A digest or key: 32 hexadecimal digits or more, or 24 letters and digits of all sorts.
_KEY = re.compile(r"[0-9A-Fa-f]{32,}|(?=\S*[0-9])(?=\S*[a-z])(?=\S*[A-Z])[0-9A-Za-z_+/=-]{24,}")
_EDGES = "\"'`.,;:!?()[]{}<>|*"
_AROUND = _EDGES + "=#$%&/\\~^_-"
_SEARCHED = np.zeros(256, bool)
_SEARCHED[list(b"0123456789@")] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed patterns, by kind."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return dict(zip(KINDS, (emails(text), ips, cards, phones), strict=True))


def _short(word: str) -> str:
    word = word.strip(_AROUND).lower()
    return word if len(word) <= LONGEST else hashlib.md5(word.encode()).hexdigest()


def _letters(text: str) -> bool:
    return any(map(str.isalnum, text))


class _Words:
    """The words around any place of a text, however far they are."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [s for s, _ in self.spans]

    def before(self, at: int) -> list[str]:
        """Up to two words before a place, the nearest last; what stands before
        it in its own token counts."""
        k, out = bisect_right(self.starts, at) - 1, []
        while k >= 0 and len(out) < 2:
            s, e = self.spans[k]
            word = self.text[s : min(e, at)]
            if _letters(word):
                out.append(word)
            k -= 1
        return out[::-1]

    def after(self, at: int) -> str:
        k = max(0, bisect_right(self.starts, at) - 1)
        while k < len(self.spans):
            s, e = self.spans[k]
            word = self.text[max(s, at) : max(e, at)]
            if _letters(word):
                return word
            k += 1
        return ""


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str | None]]:
    """Tokens with a digit or an @ that overlap nothing taken (sorted spans);
    adjacent numbers are one.  Those that look like keys have their kind."""
    out: list[tuple[int, int, str | None]] = []
    k, last = 0, None
    for m in _TOKEN.finditer(text):
        word = m[0]
        if not _MARKS.search(word):
            last = None
            continue
        s = m.start() + len(word) - len(word.lstrip(_EDGES))
        e = m.end() - (len(word) - len(word.rstrip(_EDGES)))
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if s >= e or any(s < b for _, b in takewhile(lambda x: x[0] < e, islice(taken, k, None))):
            last = None
            continue
        number = bool(_NUMBER.fullmatch(word))
        if number and ")" in word and text[s - 1 : s] == "(" and s > m.start():
            s -= 1
        if number and last is not None and not text[last : m.start()].strip("\x20\t"):
            out[-1] = (out[-1][0], e, None)
        else:
            out.append((s, e, SECRET if _KEY.fullmatch(text, s, e) else None))
        # after a comma or the like another instance begins
        last = m.end() if number and word[-1] not in ",;.:" else None
    return out


def occurrences(text: str, base: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seeds (with their kind) and candidates, with their patterns."""
    found = [(s, e, kind) for kind in KINDS for s, e in base[kind]]
    every = sorted(found + candidates(text, sorted((s, e) for s, e, _ in found)), key=lambda x: x[:2])
    if not every:
        return []
    words, out = _Words(text), []
    for s, e, kind in every:
        before = words.before(s)
        if not before or not any(c.isalpha() for c in before[-1]):
            continue
        left, right = [_short(w) for w in before], _short(words.after(e))
        patterns = [f"{left[-1]} _", f"{left[-1]} _ {right}"] + ([f"{left[0]} {left[1]} _"] if len(left) == 2 else [])
        out.append({"kind": kind, "start": s, "end": e, "instance": _short(text[s:e]), "patterns": patterns})
    return out


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


_OCC = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, the fixed patterns' counts and spans, and
    the occurrences that the learning works on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest string, {', '.join(f'n_{k} long' for k in KINDS)}, base string, occ array<struct<kind: string, start: long, `end`: long, instance: string, patterns: array<string>>>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for start, end, data, offs in pieces(texts):
                rows = []
                marked = per_row(_SEARCHED[data], offs) > 0
                for k in range(end - start):
                    if not marked[k]:
                        rows.append(("", 0, 0, 0, 0, "", []))
                        continue
                    text = texts[start + k].as_py()
                    base = base_spans(text)
                    rows.append((hashlib.md5(text.encode()).hexdigest(), *(len(base[x]) for x in KINDS), _joined(base), occurrences(text, base)))
                cols = list(zip(*rows, strict=True))
                types = [pa.string(), *[pa.int64()] * 4, pa.string(), _OCC]
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "digest", *(f"n_{x}" for x in KINDS), "base", "occ"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def learn(occ: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """From occurrences (kind, instance, pattern): confident patterns
    (pattern, kind, confidence) and scored instances (instance, kind, score)."""
    edges = written(occ.select("pattern", "instance").distinct(), "pii-edges")
    seeds = written(occ.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    now = seeds
    for _ in range(rounds):
        support = edges.join(now.filter(F.col("score") >= ACCEPT), "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("total")).filter(F.col("n") >= MIN_SEEDS)
        patterns = support.join(size, "pattern").select("pattern", "kind", (F.col("total") / (F.col("size") + 1)).alias("confidence")).filter(F.col("confidence") >= TRUST)
        patterns = written(patterns, "pii-patterns")
        new = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        now = written(new.join(seeds.select("instance"), "instance", "left_anti").union(seeds), "pii-scores")
    return patterns, now


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, counts and ``base`` spans, and ``added``: spans (kind, start,
    end) that the learned patterns give beyond them."""
    found = written(find(docs), "pii-found")
    occ = found.filter(F.size("occ") > 0).select("doc_id", "digest", F.inline("occ"))
    occ = written(occ.select("doc_id", "digest", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern")), "pii-occurrences")
    patterns, scores = learn(occ)
    good = scores.filter(F.col("score") >= ACCEPT).withColumnRenamed("kind", "as_kind").select("instance", "as_kind", "score")
    added = occ.filter((F.col("kind").isNull()) | (F.col("kind") == SECRET)).join(patterns.withColumnRenamed("kind", "as_kind"), "pattern").join(good, ["instance", "as_kind"])
    one = added.groupBy("doc_id", "digest", "start", "end").agg(F.max_by("as_kind", F.struct("score", "as_kind")).alias("kind"))
    per = one.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "added")
    both = found.drop("occ").join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    return both.drop("__id", "__digest", "digest")


def op_spans(out: DataFrame) -> DataFrame:
    """The digest columns of ``extract``'s rows."""
    # all spans in the order of the kinds, then of the starts
    parts = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("long").alias("start"), F.split(x, ":")[2].cast("long").alias("end")))
    every = F.when(F.col("added").isNull(), parts).otherwise(F.concat(parts, F.col("added")))
    rank = F.array(*map(F.lit, (*KINDS, SECRET)))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(F.array_position(rank, x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))))
    spans = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.when(F.col("added").isNull(), F.col("base")).otherwise(spans).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).alias("n_added"), (sum(F.col(f"n_{k}") for k in KINDS) + F.coalesce(F.size("added"), F.lit(0))).alias("n_spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_spans(extract(load(spark, sf_dir)))
