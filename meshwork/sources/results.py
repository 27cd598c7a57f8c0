"""Benchmark log lines: ``RESULT key=value ...`` records, their repetitions,
and read-benchmark records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import ranked

#: The typed keys; any other key stays a string.
INT_KEYS = ("P", "rank")
LONG_KEYS = ("nrows_local", "ncols_global", "nnz_local", "n_ghost", "M", "N", "nnz_expanded")
DOUBLE_KEYS = (
    "compute_avg_ms", "compute_min_ms", "compute_max_ms", "compute_var_ms", "compute_gflops", "eff_bw_gbs", "pct_peak_bw", "comm_avg_ms", "comm_min_ms", "comm_max_ms", "comm_var_ms",
    "total_avg_ms", "total_min_ms", "total_max_ms", "total_var_ms", "effective_gflops", "avg_ms", "min_ms", "max_ms", "gflops",
)
STRING_KEYS = ("comm", "kernel", "matrix")
READ_DOUBLES = ("serial_mean_ms", "serial_min_ms", "chunked_mean_ms", "chunked_min_ms", "serial_read_ms", "serial_distribute_ms", "chunked_io_ms", "chunked_parse_ms", "chunked_redistribute_ms")
READ_LONGS = ("nnz_total_serial", "nnz_total_chunked", "spmv_mismatches")


#: White space around a line that does not count.
AROUND = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


def numbered_lines(spark: SparkSession, paths: str | list[str], prefix: str = "RESULT") -> DataFrame:
    """file, path_no, line_no and line of text files (paths or patterns), of the
    lines that begin with ``prefix`` after white space; line_no counts these in
    each file from 0.  path_no is the place of the file's path in the list given:
    files of one path or pattern come by name.  A file that several paths name
    counts once for each.

    Files are read in splits: a line's place is its split's offset and its place
    among the lines of the task, ranked within the file."""
    given = [paths] if isinstance(paths, str) else list(paths)
    texts = [spark.read.text(p).select(F.lit(k).alias("path_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.btrim("value", F.lit(AROUND)).alias("line")) for k, p in enumerate(given)]
    text = reduce(DataFrame.unionByName, texts)
    lines = ranked(text.filter(F.startswith("line", F.lit(prefix))), [F.col("__block"), F.col("__id")], "line_no", by=("path_no", "file"))
    return lines.select("file", "path_no", "line_no", "line")


def _fields(line: Column, prefix: str, keys: tuple[str, ...]) -> Column:
    """The values of ``keys`` among the key=value tokens after the prefix, as
    strings; the last token of a key counts.  The tokens are put as one JSON
    object, so that a line is parsed once for all keys."""
    rest = F.regexp_replace(F.substr(line, F.lit(len(prefix) + 1)), r"[\\\"]", r"\\$0")
    body = F.regexp_replace(rest, r"\s*(?:(\S+)=(\S+)|\S+)", r'"$1":"$2",')
    schema = ", ".join(f"`{k}` string" for k in keys)
    return F.from_json(F.concat(F.lit("{"), F.trim(body), F.lit('"":""}')), schema, {"allowUnquotedControlChars": "true"})


def _typed(lines: DataFrame, prefix: str, strings: tuple, ints: tuple, longs: tuple, doubles: tuple, carry: tuple = ()) -> DataFrame:
    rows = lines.filter(F.startswith("line", F.lit(prefix)))
    at = [c for c in ("file", "path_no", "line_no", *carry) if c in lines.columns]
    rows = rows.select(*at, _fields(F.col("line"), prefix, (*strings, *ints, *longs, *doubles)).alias("fields")).select(*at, "fields.*")
    kinds = {**dict.fromkeys(ints, "int"), **dict.fromkeys(longs, "long"), **dict.fromkeys(doubles, "double")}
    return rows.withColumns({k: F.col(k).try_cast(kind) for k, kind in kinds.items()})


def malformed(lines: DataFrame) -> DataFrame:
    """file, line_no, key and value of typed values of ``RESULT `` lines that are
    no numbers; ``parse`` gives null for these."""
    kinds = {**dict.fromkeys(INT_KEYS, "int"), **dict.fromkeys(LONG_KEYS, "long"), **dict.fromkeys(DOUBLE_KEYS, "double")}
    rows = lines.filter(F.startswith("line", F.lit("RESULT "))).select("file", "line_no", _fields(F.col("line"), "RESULT ", tuple(kinds)).alias("fields"))
    wrong = [F.when(F.col(f"fields.{k}").isNotNull() & F.col(f"fields.{k}").try_cast(kind).isNull(), F.struct(F.lit(k).alias("key"), F.col(f"fields.{k}").alias("value"))) for k, kind in kinds.items()]
    return rows.select("file", "line_no", F.inline(F.filter(F.array(*wrong), lambda x: x.isNotNull())))


def parse(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Records of the lines (file, line_no, line) that begin with ``RESULT ``;
    ``carry`` names columns of the lines that stay."""
    return _typed(lines, "RESULT ", STRING_KEYS, INT_KEYS, LONG_KEYS, DOUBLE_KEYS, carry)


def parse_reads(lines: DataFrame) -> DataFrame:
    """Read-benchmark records; lines of the old schema are left out."""
    rows = _typed(lines, "RESULT_CSV_READ ", ("matrix", "check"), ("P", "reps"), READ_LONGS, READ_DOUBLES)
    return rows.filter("chunked_mean_ms IS NOT NULL")


def old_reads(lines: DataFrame) -> DataFrame:
    """How many read-benchmark lines have the old schema."""
    prefix = "RESULT_CSV_READ "
    rows = lines.filter(F.startswith("line", F.lit(prefix)))
    return rows.agg(F.count_if(_fields(F.col("line"), prefix, ("chunked_mean_ms",))["chunked_mean_ms"].isNull()).alias("skipped"))


def repetitions(records: DataFrame, keys: tuple[str, ...] = ("matrix", "comm", "kernel", "P")) -> DataFrame:
    """Records with ``rep``: each P lines of a group, in the order of the paths
    (where they have ``path_no``), files and lines, are one repetition; a last one of fewer lines is dropped.  The groups are few and
    large: places in them come from ``ranked``."""
    order = [F.col(c) for c in ("path_no", "file", "line_no") if c in records.columns]
    rows = ranked(records.filter(F.col("P") > 0), order, "__k", by=keys).withColumn("rep", F.floor(F.col("__k") / F.col("P")))
    return rows.withColumn("__n", F.count("*").over(W.partitionBy(*keys, "rep"))).filter(F.col("__n") == F.col("P")).drop("__k", "__n")


def lines_of(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """RESULT lines of records; null values are left out."""
    return records.select(F.concat_ws(" ", F.lit("RESULT"), *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys)).alias("line"))
