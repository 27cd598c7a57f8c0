"""Phases of a query: what a run of it took in computing and in moving data, as
RESULT lines that the log analytics read.

The run is one job group; its figures are those that Spark keeps for every
stage.  Rows are counted while they pass, by observations, not by jobs of their
own.  Times are of tasks, averaged over them; the total is the wall clock's."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from ..operators.spmv import spmv
from ..sources import results


@dataclass(frozen=True)
class Phases:
    """Tasks, and milliseconds: of all tasks together (compute, moving), and of
    the run (total); bytes that were shuffled."""

    tasks: int
    compute_ms: float
    moving_ms: float
    total_ms: float
    shuffled: int


def measured(df: DataFrame) -> Phases:
    """Runs ``df`` to its end, keeping no rows."""
    sc, group = df.sparkSession.sparkContext, f"phases-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "phases")
    try:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        total = (time.perf_counter() - began) * 1e3
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jvm = sc._jsc.sc()
    jvm.listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), jvm.statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = compute = moving = shuffled = 0
    for s in stages:
        data = store.lastStageAttempt(s)
        if data.numCompleteTasks():
            # waiting for blocks in ms, writing them in ns
            moved = data.shuffleFetchWaitTime() + data.shuffleWriteTime() / 1e6
            tasks += data.numCompleteTasks()
            moving += moved
            compute += max(0.0, data.executorRunTime() - moved)
            shuffled += data.shuffleWriteBytes()
    return Phases(tasks, compute, moving, total, shuffled)


def product_line(m: SparseMatrix, x: DataFrame, matrix: str, exchange: str, kernel: str, parts: int) -> str:
    """One product as a RESULT line: entries and rows as observed, times as measured."""
    seen, made = Observation(), Observation()
    entries = m.df.observe(seen, F.count("*").alias("nnz"))
    y = spmv(SparseMatrix(entries, m.nrows, m.ncols), x, exchange=exchange, kernel=kernel, parts=parts).observe(made, F.count("*").alias("rows"))
    p = measured(y)
    nnz, each = seen.get["nnz"], max(1, p.tasks)
    fields = {
        "comm": exchange, "kernel": kernel, "matrix": matrix, "P": 1, "rank": 0, "nrows_local": made.get["rows"], "ncols_global": m.ncols, "nnz_local": nnz,
        "compute_avg_ms": p.compute_ms / each, "comm_avg_ms": p.moving_ms / each, "total_avg_ms": p.total_ms, "effective_gflops": 2 * nnz / (p.total_ms * 1e6),
    }
    return " ".join(["RESULT", *(f"{k}={v}" for k, v in fields.items())])


def written_lines(spark: SparkSession, lines: list[str], path: str) -> DataFrame:
    """The lines as a log file below ``path``, and the records read back from it."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    return results.parse(results.numbered_lines(spark, path, "RESULT "))
