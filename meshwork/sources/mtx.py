"""Matrix Market files: coordinate matrices as entries, and back.

The header is read from the first lines; entries are parsed by Spark's
splittable text reader, so large files are read in parallel ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix, symmetrize

FORMATS = ("coordinate", "array")
FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


class MatrixMarketError(ValueError):
    code = 0


class PrematureEnd(MatrixMarketError):
    code = 12


class NotMatrix(MatrixMarketError):
    code = 13


class NoHeader(MatrixMarketError):
    code = 14


class Unsupported(MatrixMarketError):
    code = 15


@dataclass(frozen=True)
class Header:
    nrows: int
    ncols: int
    nnz_file: int
    format: str
    field: str
    symmetry: str

    @property
    def banner(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.field} {self.symmetry}"


def banner(line: str) -> tuple[str, str, str]:
    """Format, field and symmetry; case does not matter after the first word."""
    words = line.split()
    if len(words) < 5:
        raise PrematureEnd("the banner has five words")
    if words[0] != "%%MatrixMarket":
        raise NoHeader(words[0])
    kind, fmt, field, symmetry = (w.lower() for w in words[1:5])
    if kind != "matrix":
        raise NotMatrix(kind)
    if fmt not in FORMATS or field not in FIELDS or symmetry not in SYMMETRIES:
        raise Unsupported(line.strip())
    if not valid(fmt, field, symmetry):
        raise Unsupported(line.strip())
    return fmt, field, symmetry


def valid(fmt: str, field: str, symmetry: str) -> bool:
    if fmt == "array" and field == "pattern":
        return False
    if field == "real" and symmetry == "hermitian":
        return False
    return not (field == "pattern" and symmetry in ("hermitian", "skew-symmetric"))


def header(lines: list[str]) -> Header:
    """From the first lines of a file: comments and blank lines may precede the sizes."""
    if not lines:
        raise PrematureEnd("the file is empty")
    fmt, field, symmetry = banner(lines[0])
    for line in lines[1:]:
        if line.strip() and not line.startswith("%"):
            try:
                sizes = [int(x) for x in line.split()]
            except ValueError:
                raise PrematureEnd(f"sizes expected: {line!r}") from None
            if len(sizes) < (3 if fmt == "coordinate" else 2):
                raise PrematureEnd(f"sizes expected: {line!r}")
            nnz = sizes[2] if fmt == "coordinate" else sizes[0] * sizes[1]
            return Header(sizes[0], sizes[1], nnz, fmt, field, symmetry)
    raise PrematureEnd("no sizes")


def entries_of(lines: DataFrame, complex_values: bool = False) -> DataFrame:
    """0-based entries of data lines (``value``): white space apart, comments
    and blank lines skipped, a missing value 1."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter(~F.startswith(F.ltrim("value"), F.lit("%")) & (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")).select(parts.alias("p"))
    value = F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0))
    cols = [(F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j")]
    if complex_values:
        imaginary = F.coalesce(F.try_element_at("p", F.lit(4)).cast("double"), F.lit(0.0))
        return rows.select(*cols, F.struct(value.alias("re"), imaginary.alias("im")).alias("v"))
    return rows.select(*cols, value.alias("v"))


_LINE = r"^\s*(%.*)?$"  # comments and blank lines


def _head(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header, and the lines after it.  A file may come in parts: the first
    by name holds the header.  Its lines are numbered as they are read, and only
    as much of it is read as there are comments before the sizes."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise PrematureEnd(path)
    first = spark.read.text(files[0]).withColumn("__at", F.monotonically_increasing_id())
    lines = [r["value"] for r in first.limit(1).collect()]
    size = first.filter((F.col("__at") > 0) & ~F.col("value").rlike(_LINE)).limit(1).collect()
    h = header(lines + [r["value"] for r in size])
    rest = first.filter(F.col("__at") > size[0]["__at"]).select("value")
    return h, rest.union(spark.read.text(files[1:])) if files[1:] else rest


def read_header(spark: SparkSession, path: str) -> Header:
    return _head(spark, path)[0]


def read(spark: SparkSession, path: str, expand: bool = True) -> SparseMatrix:
    """A coordinate matrix; with ``expand``, the symmetric half is mirrored."""
    h, lines = _head(spark, path)
    if h.format != "coordinate" or h.field == "complex" or h.symmetry == "hermitian":
        raise Unsupported(h.banner)
    entries = entries_of(lines)
    if h.field == "pattern":
        entries = entries.withColumn("v", F.lit(1.0))
    if expand and h.symmetry != "general":
        entries = symmetrize(entries, skew=h.symmetry == "skew-symmetric")
    return SparseMatrix(entries, h.nrows, h.ncols)


def read_complex(spark: SparkSession, path: str) -> DataFrame:
    """Entries with v = (re, im), unexpanded."""
    h, lines = _head(spark, path)
    if h.field != "complex":
        raise Unsupported("not a complex matrix")
    return entries_of(lines, complex_values=True)


def entry_lines(m: SparseMatrix, pattern: bool = False) -> DataFrame:
    """The data lines of a coordinate file."""
    cols = [F.col("i") + 1, F.col("j") + 1, *([] if pattern else [F.col("v")])]
    return m.df.select(F.concat_ws(" ", *(c.cast("string") for c in cols)).alias("value"))


def write(m: SparseMatrix, path: str, pattern: bool = False) -> None:
    """A folder of part files that make one coordinate file, end to end by their
    names; the header is the first part.  Entries are counted by their own scan
    before they are written."""
    spark = m.df.sparkSession
    h = Header(m.nrows, m.ncols, m.df.count(), "coordinate", "pattern" if pattern else "real", "general")
    head = spark.createDataFrame([(h.banner,), (f"{h.nrows} {h.ncols} {h.nnz_file}",)], "value string").coalesce(1)
    head.unionByName(entry_lines(m, pattern)).write.text(path)
