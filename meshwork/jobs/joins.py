"""Registered queries of the as-of join, the range join and the sketches on the
driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udtfs
from ..operators.ranges import range_join
from ..operators.temporal import asof_join
from . import sketches
from .matrices import PP_SQL, Query, pp_matrix, read

#: Orders are placed within the days of the events, in microseconds.
DAY0, SPAN = 1_704_067_200_000_000, 2_592_000


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit(DAY0) + (F.col("o_orderkey") * 173 % SPAN) * 1_000_000
    return read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user"), at.alias("at"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value")


def _asof(spark: SparkSession, sf: str) -> DataFrame:
    out = asof_join(_orders(spark, sf), _events(spark, sf), "at", "ts", tie="event_id")
    return out.select("o_orderkey", "at", F.col("matched.event_id").alias("event_id"), F.col("matched.value").alias("value"))


def _asof_user(spark: SparkSession, sf: str) -> DataFrame:
    out = asof_join(_orders(spark, sf), _events(spark, sf), "at", "ts", by=(("user", "user_id"),), tie="event_id", strict=True)
    return out.select("o_orderkey", "user", F.col("matched.event_id").alias("event_id"))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value lies in a part's range: most are narrow, some wide."""
    low = F.round((F.col("p_retailprice") - 900) * 4, 2)
    parts = read(spark, sf, "part").select("p_partkey", low.alias("low"), (low + F.when(F.col("p_size") == 50, 5.0).otherwise(F.col("p_size") / 100)).alias("high"))
    return range_join(read(spark, sf, "events").select("event_id", "value"), parts, "value", "low", "high").select("p_partkey", "event_id")


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    """Two logs' summaries, merged; the sketches' medians against exact ranks."""
    from .queries import records

    rows = records(spark, sf).select(*sketches.DIMENSIONS, "total_avg_ms", "event_id")
    halves = [sketches.summarised(rows.filter(F.col("event_id") % 2 == k)) for k in (0, 1)]
    got = sketches.cube(sketches.merged(halves))
    exact = rows.cube(*sketches.DIMENSIONS).agg(F.grouping_id().cast("int").alias("g"), F.percentile("total_avg_ms", F.array(F.lit(0.47), F.lit(0.53))).alias("e"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in sketches.DIMENSIONS]
    both = got.alias("a").join(exact.alias("b"), [*same, F.col("a.grouping") == F.col("b.g")])
    near = (F.col("a.median") >= F.floor(F.col("b.e")[0])) & (F.col("a.median") <= F.ceil(F.col("b.e")[1]))
    return both.select(*(f"a.{c}" for c in sketches.DIMENSIONS), "grouping", "n", "least", "greatest", F.round("average", 9).alias("average"), "n_matrices", near.alias("median_near"))


def _sql_text(query: str, view: str, rows) -> Query:
    """SQL text over a temporary view of ``rows(spark, sf)``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        udtfs.register(spark)
        rows(spark, sf).createOrReplaceTempView(view)
        return spark.sql(query)

    return run


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    from .queries import log_lines

    return log_lines(spark, sf)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return pp_matrix(spark, sf).df


QUERIES: dict[str, Query] = {
    "sql_row_stats": _sql_text("SELECT i, sum(nnz) AS nnz, sum(total) AS total, min(low) AS low, max(high) AS high FROM row_parts(TABLE(sql_entries)) GROUP BY i", "sql_entries", _entries),
    "sql_mirrored": _sql_text("SELECT i, j, sum(v) AS v, count(*) AS n FROM mirrored(TABLE(sql_pattern)) GROUP BY i, j", "sql_pattern", _entries),
    "sql_records": _sql_text("SELECT comm, kernel, P, count(*) AS n, sum(nnz_local) AS nnz, max(total_avg_ms) AS most FROM result_records(TABLE(sql_lines)) GROUP BY comm, kernel, P", "sql_lines", _lines),
    "asof_orders": _asof,
    "asof_user_orders": _asof_user,
    "range_join": _ranges,
    "run_cube": _cube,
}

_ORDERS = f"orders2 AS (SELECT o_orderkey, o_custkey % 150 AS \"user\", {DAY0} + (o_orderkey * 173 % {SPAN}) * 1000000 AS at FROM orders), events2 AS (SELECT event_id, user_id, epoch_us(ts) AS ts, value FROM events)"


def sql(records_sql: str) -> dict[str, str]:
    dims = ", ".join(f'"{c}"' for c in sketches.DIMENSIONS)
    return {
        "sql_row_stats": f"WITH {PP_SQL} SELECT i, count(*) AS nnz, sum(v) AS total, min(j) AS low, max(j) AS high FROM pp GROUP BY i",
        "sql_mirrored": f"WITH {PP_SQL} SELECT i, j, sum(v) AS v, count(*) AS n FROM (SELECT i, j, v FROM pp UNION ALL SELECT j, i, v FROM pp WHERE i <> j) GROUP BY i, j",
        "sql_records": f'WITH {records_sql} SELECT comm, kernel, "P", count(*) AS n, CAST(sum(nnz_local) AS BIGINT) AS nnz, max(total_avg_ms) AS most FROM records GROUP BY ALL',
        "asof_orders": f"WITH {_ORDERS}, e AS (SELECT ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events2 GROUP BY ts) SELECT o.o_orderkey, o.at, e.event_id, e.value FROM orders2 o ASOF LEFT JOIN e ON o.at >= e.ts",
        "asof_user_orders": f"WITH {_ORDERS}, e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events2 GROUP BY ALL) SELECT o.o_orderkey, o.\"user\", e.event_id FROM orders2 o ASOF LEFT JOIN e ON o.\"user\" = e.user_id AND o.at > e.ts",
        "range_join": "WITH p AS (SELECT p_partkey, round((p_retailprice - 900) * 4, 2) AS low, p_size FROM part), q AS (SELECT p_partkey, low, low + CASE WHEN p_size = 50 THEN 5.0::DOUBLE ELSE p_size / 100 END AS high FROM p) SELECT p_partkey, event_id FROM q JOIN events ON value >= low AND value < high",
        "run_cube": f"WITH {records_sql} SELECT {dims}, grouping({dims}) AS grouping, count(*) AS n, min(total_avg_ms) AS least, max(total_avg_ms) AS greatest, round(avg(total_avg_ms), 9) AS average, count(DISTINCT matrix) AS n_matrices, true AS median_near FROM records GROUP BY CUBE ({dims})",
    }
