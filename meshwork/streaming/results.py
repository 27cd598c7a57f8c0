"""Benchmark log lines as a stream (an extension: the log analytics are batch
jobs elsewhere): new files of a folder are parsed as they appear."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.results import AROUND, parse

UNITS = {"datetime64[ns]": "ns", "datetime64[us]": "us"}


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the RESULT lines of all files, as a streaming DataFrame.
    Lines are not numbered: repetitions need the batch reader."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    return parse(lines).drop("line_no")


def running_stats(records: DataFrame) -> DataFrame:
    """Samples, average, least and greatest total time of each exchange and kernel so far."""
    return records.groupBy("comm", "kernel").agg(F.count("*").alias("n"), F.avg("total_avg_ms").alias("avg_ms"), F.min("total_avg_ms").alias("min_ms"), F.max("total_avg_ms").alias("max_ms"))


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """The RESULT lines of a folder's files as they appear: file, at (when the
    file was written), line_no (orders the lines of a file) and line."""
    text = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_block_start").alias("block"), F.btrim("value", F.lit(AROUND)).alias("line"))
    lines = lines.filter(F.startswith("line", F.lit("RESULT ")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a split is read by one task, in its order
        n = TaskContext.get().partitionId() << 33
        for b in batches:
            yield b.append_column("id", pa.array(range(n, n + b.num_rows), pa.int64()))
            n += b.num_rows

    return lines.mapInArrow(number, "file string, at timestamp, block long, line string, id long").withColumn("line_no", F.struct("block", "id")).drop("block", "id")


def stream_repetitions(lines: DataFrame, late: str = "1 hour", patience_ms: int = 24 * 3_600_000) -> DataFrame:
    """Each P lines of a (matrix, comm, kernel, P) group, in the order of files
    and lines, as one repetition, emitted when its last line is there: the keys,
    rep, place (of the line in it), file, at, rank, nnz_local and total_avg_ms.

    The state of a group is the number of repetitions and the lines of the open
    one (fewer than P).  Lines of files that are older than the watermark (``late``
    behind the newest) are dropped; an open repetition that no line has joined for
    ``patience_ms`` of watermark time is cut short, as the batch reader drops a
    last one of fewer lines."""
    keys = ["matrix", "comm", "kernel", "P"]
    kept = ["file", "at", "rank", "nnz_local", "total_avg_ms"]
    rows = parse(lines.withColumns({"time": F.col("at"), "no": F.col("line_no")}), carry=("time", "no")).filter(F.col("P") > 0)
    rows = rows.select(*keys, "file", F.col("time").alias("at"), F.col("no.block").alias("block"), F.col("no.id").alias("id"), "rank", "nnz_local", "total_avg_ms").withWatermark("at", late)
    out = "matrix string, comm string, kernel string, P int, rep long, place int, file string, at timestamp, rank int, nnz_local long, total_avg_ms double"

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        if state.hasTimedOut:
            state.update((done, "[]"))  # the numbers go on
            return
        new = pd.concat(list(frames)).sort_values(["at", "file", "block", "id"], kind="stable")
        stamps = new["at"]
        latest = int(stamps.max().timestamp() * 1000) if len(new) else 0
        fresh = new[kept].assign(at=stamps.astype("int64")).astype(object).where(new[kept].notna(), None).values.tolist()
        held += [[*r[:1], int(r[1]), *r[2:]] for r in fresh]
        parts = int(key[3])
        whole = len(held) // parts * parts
        if whole:
            made = pd.DataFrame(held[:whole], columns=kept)
            made["at"] = pd.to_datetime(made["at"].astype("int64"), unit=UNITS[str(stamps.dtype)])
            made = made.assign(rep=[done + k // parts for k in range(whole)], place=[k % parts for k in range(whole)], **dict(zip(keys, key, strict=True)))
            yield made[[*keys, "rep", "place", *kept]]
        state.update((done + whole // parts, json.dumps(held[whole:], default=float)))
        if held[whole:]:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + patience_ms)

    return rows.groupBy(*keys).applyInPandasWithState(advance, out, "done long, held string", "append", GroupStateTimeout.EventTimeTimeout)
