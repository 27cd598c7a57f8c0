"""Operators for SQL text: table functions over any table or view, after
``register``:

    SELECT i, sum(nnz) AS nnz FROM row_parts(TABLE(a)) GROUP BY i
    SELECT * FROM mirrored(TABLE(a))
    SELECT * FROM result_records(TABLE(lines))

None asks for a partitioning: each works on the rows that a task has anyway, so
a hot row or group moves nothing.  ``row_parts`` gives partial statistics, as a
map-side combine does, and the query's GROUP BY adds them up.  They are for SQL
users; the DataFrame operators say the same in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..sources.results import DOUBLE_KEYS, INT_KEYS, LONG_KEYS, STRING_KEYS

#: Rows of the matrix that a task of ``row_parts`` holds before it gives its sums out.
HELD = 100_000


class RowParts:
    """Entries, their sum, and the least and greatest column of each row i."""

    def __init__(self) -> None:
        self.held: dict = {}

    def _out(self) -> Iterator[tuple]:
        for i, (n, total, low, high) in self.held.items():
            yield i, n, total, low, high
        self.held = {}

    def eval(self, row: Row) -> Iterator[tuple]:
        i, j, v = row["i"], row["j"], row["v"]
        n, total, low, high = self.held.get(i, (0, 0.0, j, j))
        self.held[i] = n + 1, total + v, min(low, j), max(high, j)
        if len(self.held) >= HELD:
            yield from self._out()

    def terminate(self) -> Iterator[tuple]:
        yield from self._out()


class Mirrored:
    """Entries and, off the diagonal, their mirror images."""

    def eval(self, row: Row) -> Iterator[tuple]:
        i, j, v = row["i"], row["j"], row["v"]
        yield i, j, v
        if i != j:
            yield j, i, v


def _number(kind: type, text: str | None):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


class ResultRecords:
    """Typed records of the lines (``line``) that begin with RESULT; values that
    are no numbers are null."""

    def eval(self, row: Row) -> Iterator[tuple]:
        line = (row["line"] or "").strip()
        if not line.startswith("RESULT "):
            return
        fields = dict(token.split("=", 1) for token in line.split()[1:] if "=" in token)
        yield (*(fields.get(k) for k in STRING_KEYS), *(_number(int, fields.get(k)) for k in (*INT_KEYS, *LONG_KEYS)), *(_number(float, fields.get(k)) for k in DOUBLE_KEYS))


_RECORD = ", ".join([*(f"{k} string" for k in STRING_KEYS), *(f"{k} int" for k in INT_KEYS), *(f"{k} long" for k in LONG_KEYS), *(f"{k} double" for k in DOUBLE_KEYS)])


def register(spark: SparkSession) -> None:
    spark.udtf.register("row_parts", udtf(RowParts, returnType="i long, nnz long, total double, low long, high long"))
    spark.udtf.register("mirrored", udtf(Mirrored, returnType="i long, j long, v double"))
    spark.udtf.register("result_records", udtf(ResultRecords, returnType=_RECORD))
