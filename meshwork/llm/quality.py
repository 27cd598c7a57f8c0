"""Quality rules: robust multivariate outliers.

Method: minimum covariance determinant for each language and source.  A
document's statistics are transformed to a vector; of each group the half with
the smallest Mahalanobis distances gives the estimate.  Large groups are cut
into cells of about ``CELL`` documents by hash (a hot source too); each cell
concentrates from a robust start, the cells' estimates are averaged, and
concentration steps over the whole group follow, as sums that Spark aggregates,
with the half's distance from a mergeable quantile sketch.  A last reweighted
step sets the final estimate; documents beyond ``CUT`` are rejected.

Variances have a floor for each statistic (``FLOOR``): most documents have no
symbol or repeated line at all, and an estimate of zero would reject every
document that has one.

The base rule comes first: too few words or too many repeated ones.  Documents
that fail it take no part in the estimates.  Groups of fewer than ``LEAST``
documents are pooled within their language, these again over all languages; a
pool of fewer than ``FEWEST`` documents rejects nothing.

Null text has no words, and so fails the base rule; a null language or source
is a value like any other; rows with equal ids are separate documents; an empty
table gives an empty result.  Other columns are carried by ``judge``; those
named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, boxed, column, lean, load, mix64, per_row, pieces, unboxed, word_hashes, written

MIN_WORDS, MOST_REPEATED = 50, 50
CELL, LEAST, FEWEST = 1000, 100, 20
HALF = 0.5
STEPS, SETTLED = 8, 1e-4  # at most so many steps over the whole; a fall of the log determinants that ends them
#: log of the mean word length, root of symbols a word, shares of repeated lines and words
DIMS = 4
FLOOR = (0.05, 0.05, 0.15, 0.10)
#: Quantiles of chi-square with four degrees of freedom: the median, 0.975, and 1 - 1e-7.
MEDIAN, MOST_GOOD, CUT = 3.3567, 11.1433, 38.19
#: Makes the covariance of the inner half, and of the inner 0.975, that of all (normal law).
HALF_FACTOR, GOOD_FACTOR = 1 / 0.3003, 1 / 0.9267

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = tuple(f"__v{k}" for k in range(DIMS))
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def repeated_words(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row, the words in 3-word windows found at least twice in it."""
    n = len(hashes)
    flag = np.zeros(n, bool)
    if n >= 3:
        row = np.repeat(np.arange(len(words)), words)
        at = np.flatnonzero(row[:-2] == row[2:])
        window = mix64(hashes[at] * _ODD[0] + hashes[at + 1] * _ODD[1] + hashes[at + 2] * _ODD[2] + row[at].astype(np.uint64) * _ODD[3])
        order = np.argsort(window)
        s = window[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        flag[at] = flag[at + 1] = flag[at + 2] = True
    return per_row(flag, np.concatenate([[0], np.cumsum(words)]))


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts of the contract."""
    names = [c for c in docs.columns if c not in COUNTS]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column(batch, "text")
            got: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
            for _, _, data, offs in pieces(text):
                starts, ends, words, hashes = word_hashes(data, offs, fold=False)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
                upto = np.concatenate([[0], np.cumsum(words)])
                got["n_words"].append(words)
                got["word_chars"].append(chars[upto[1:]] - chars[upto[:-1]])
                got["n_symbols"].append(per_row(_SYMBOL[data], offs))
                got["n_repeat_words"].append(repeated_words(hashes, words))
            got["n_dup_lines"].append(np.array([repeated_lines(x.as_py() or "") for x in text], np.int64))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *(pa.array(np.concatenate([np.zeros(0, np.int64), *got[c]]), pa.int64()) for c in COUNTS)], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)), F.col("n_repeat_words") / n]


def _distance(v: list[Column], mean: str = "__mean", inverse: str = "__inverse") -> Column:
    """Squared Mahalanobis distance; ``inverse`` holds the upper triangle."""
    d = [v[k] - F.col(mean)[k] for k in range(DIMS)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + d[i] * d[j] * F.col(inverse)[k] * (1 if i == j else 2)
    return total


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(np.square(FLOOR)))


def _concentrate(x: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps within one cell, from medians and median deviations."""
    mean = np.median(x, axis=0)
    cov = np.diag(np.square(1.4826 * np.median(np.abs(x - mean), axis=0)))
    h = max(1, int(np.ceil(HALF * len(x))))
    held: np.ndarray | None = None
    for _ in range(steps):
        d = x - mean
        near = np.sort(np.argpartition(np.einsum("ni,ij,nj->n", d, _inverse(cov), d), h - 1)[:h])
        if held is not None and np.array_equal(near, held):
            break
        held, mean = near, x[near].mean(axis=0)
        cov = HALF_FACTOR * np.cov(x[near].T, bias=True)
    return mean, cov


def _estimates(rows: DataFrame) -> DataFrame:
    """From g, mean and cov (upper triangle): these, the inverse and the
    logarithm of the determinant, both with the floor."""

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list[float]] = []
            size: list[float] = []
            for flat in f["cov"]:
                m = np.zeros((DIMS, DIMS))
                for value, (i, j) in zip(flat, PAIRS, strict=True):
                    m[i, j] = m[j, i] = value
                inv = _inverse(m)
                out.append([float(inv[p]) for p in PAIRS])
                size.append(-float(np.linalg.slogdet(inv)[1]))
            yield f.assign(inverse=out, logdet=size)

    return rows.mapInPandas(run, "g string, mean array<double>, cov array<double>, inverse array<double>, logdet double")


def _moments(near: DataFrame, factor: float) -> DataFrame:
    v = [F.col(c) for c in VECTOR]
    sums = near.groupBy("g").agg(F.array(*(F.avg(x) for x in v)).alias("mean"), F.array(*(F.avg(v[i] * v[j]) for i, j in PAIRS)).alias("sq"))
    return sums.select("g", "mean", F.array(*((F.col("sq")[k] - F.col("mean")[i] * F.col("mean")[j]) * factor for k, (i, j) in enumerate(PAIRS))).alias("cov"))


def _groups(good: DataFrame) -> DataFrame:
    """The group ``g`` of each language and source, and its documents ``n``."""
    per = good.groupBy("__key").agg(F.first(F.col("__lang")).alias("__lang"), F.count("*").alias("c"))
    small = F.when(F.col("c") < LEAST, F.col("c")).otherwise(0)
    per = per.withColumn("in_lang", F.sum(small).over(W.partitionBy("__lang")))
    rest = F.when((F.col("c") < LEAST) & (F.col("in_lang") < LEAST), F.col("c")).otherwise(0)
    per = per.withColumn("in_all", F.sum(rest).over(W.partitionBy()))
    g = F.when(F.col("c") >= LEAST, F.concat(F.lit("source "), F.col("__key"))).when(F.col("in_lang") >= LEAST, F.concat(F.lit("language "), F.col("__lang"))).otherwise("all")
    n = F.when(F.col("c") >= LEAST, F.col("c")).when(F.col("in_lang") >= LEAST, F.col("in_lang")).otherwise(F.col("in_all"))
    return per.select("__key", g.alias("g"), n.alias("n"))


def fit(rows: DataFrame) -> DataFrame:
    """Estimates of every group from rows with g, n, doc_id and the vector."""
    cells = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / CELL))).select("g", "n", "cell", *VECTOR)

    def cell(f: pd.DataFrame) -> pd.DataFrame:
        mean, cov = _concentrate(f[list(VECTOR)].to_numpy(np.float64))
        return pd.DataFrame({"g": [f["g"].iloc[0]], "size": [len(f)], "mean": [mean.tolist()], "cov": [[float(cov[p]) for p in PAIRS]]})

    starts = cells.groupBy("g", "cell").applyInPandas(cell, "g string, size long, mean array<double>, cov array<double>")
    mean = [F.sum(F.col("mean")[k] * F.col("size")) / F.sum("size") for k in range(DIMS)]
    cov = [F.sum(F.col("cov")[k] * F.col("size")) / F.sum("size") for k in range(len(PAIRS))]
    now = written(_estimates(starts.groupBy("g").agg(F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))), "mcd-start")
    v = [F.col(c) for c in VECTOR]
    spread = None
    for step in range(STEPS):
        at = rows.select("g", *VECTOR).join(now, "g").select("g", *VECTOR, _distance(v, "mean", "inverse").alias("d2"))
        half = at.groupBy("g").agg(F.percentile_approx("d2", HALF, 10_000).alias("most"))
        near = at.join(half, "g").filter("d2 <= most")
        now = written(_estimates(_moments(near, HALF_FACTOR)), f"mcd-{step}")
        # one row: the steps end when no group's determinant falls any more
        last, spread = spread, now.agg(F.sum("logdet")).first()[0]
        if last is not None and spread is not None and last - spread <= SETTLED * max(1.0, abs(last)):
            break
    at = rows.select("g", *VECTOR).join(now, "g").select("g", *VECTOR, _distance(v, "mean", "inverse").alias("d2"))
    return written(_estimates(_moments(at.filter(F.col("d2") <= MOST_GOOD), GOOD_FACTOR)), "mcd-last")


OWN = ("doc_id", "lang", "source", "text")
MADE = (*COUNTS, "base_failed", "distance", "kept")


def _judged(docs: DataFrame, carry: bool) -> DataFrame:
    """``boxed`` rows (without ``carry``: doc_id alone) with the computed columns."""
    stats = statistics(boxed(docs, *OWN) if carry else docs.select(*OWN))
    stats = stats.withColumn("__lines", F.when(F.col("n_dup_lines") > 0, F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))).otherwise(1))
    stats = stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    stats = stats.withColumn("__key", F.to_json(F.struct("lang", "source"))).withColumn("__lang", F.to_json(F.struct("lang")))
    stats = stats.withColumns(dict(zip(VECTOR, _vector(), strict=True)))
    stats = written(stats if carry else stats.drop("text", "lang", "source"), "quality-stats")
    good = stats.filter("NOT base_failed")
    groups = written(_groups(good), "quality-groups")
    rows = good.select("doc_id", "__key", *VECTOR).join(groups, "__key").filter(F.col("n") >= FEWEST)
    estimates = fit(rows).join(groups, "g").select("__key", F.col("mean").alias("__mean"), F.col("inverse").alias("__inverse"))
    out = stats.join(estimates, "__key", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance([F.col(c) for c in VECTOR])))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def judge(docs: DataFrame, carry: bool = True) -> DataFrame:
    """``docs`` (with ``carry``, else only doc_id) with the counts, base_failed,
    distance (null if not judged) and kept; existing columns of these names are
    replaced, all others are carried."""
    out = _judged(docs, carry)
    return unboxed(out, docs.columns, OWN, {c: F.col(c) for c in MADE}) if carry else out.select("doc_id", *MADE)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return unboxed(_judged(docs, True).filter("kept"), docs.columns, OWN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir), carry=False).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
