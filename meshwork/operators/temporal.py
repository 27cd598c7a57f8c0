"""As-of join: each left row with the last right row that is not later.

Both sides are one table, range-partitioned and sorted by key and time; a right
row is carried forward within its partition, and from one partition to the next
by a table of one row for each partition and key in it.  So a key of any size is
spread over partitions, and no task holds more than one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: tuple[tuple[str, str], ...] = (), tie: str | None = None, strict: bool = False, name: str = "matched") -> DataFrame:
    """``left`` with ``name``, a struct of the right row of the same keys (``by``:
    pairs of a left and a right column) with the greatest ``right_time`` up to
    ``left_time`` (below it if ``strict``); of equal times the one with the
    greatest ``tie``.  Null where there is none; null times match nothing, null
    keys match null keys."""
    spark = left.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{k}" for k in range(len(by))]
    row = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("r")).schema["r"].dataType)
    last = F.lit(None).cast(right.schema[tie].dataType) if tie else F.lit(None).cast("int")
    own = left.select(*(F.col(f"`{a}`").alias(k) for k, (a, _) in zip(keys, by, strict=True)), F.col(f"`{left_time}`").alias("__t"), F.lit(0 if strict else 2).alias("__side"), last.alias("__tie"), row(left).alias("__left"), none(right).alias("__right"))
    other = right.filter(F.col(f"`{right_time}`").isNotNull()).select(*(F.col(f"`{b}`").alias(k) for k, (_, b) in zip(keys, by, strict=True)), F.col(f"`{right_time}`").alias("__t"), F.lit(1).alias("__side"), (F.col(f"`{tie}`") if tie else last).alias("__tie"), none(left).alias("__left"), row(right).alias("__right"))
    order = [F.col("__t").asc_nulls_first(), F.col("__side"), F.col("__tie")]
    parts = written(own.unionByName(other).repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id()), "asof")
    within = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # the last right row of each partition and key, and the last before it
    ends = parts.filter(F.col("__right").isNotNull()).groupBy("__part", *keys).agg(F.max_by("__right", F.struct("__t", F.coalesce("__tie", F.lit(None).cast(parts.schema["__tie"].dataType)).alias("tie"))).alias("__end"))
    every = parts.groupBy("__part", *keys).agg(F.lit(1).alias("__one"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("__part", *keys)]
    at = every.alias("a").join(ends.alias("b"), same("a", "b"), "left").select("a.__part", *(f"a.{k}" for k in keys), "b.__end")
    before = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = at.select("__part", *keys, F.last("__end", ignorenulls=True).over(before).alias("__before"))
    out = parts.withColumn("__here", F.last("__right", ignorenulls=True).over(within)).filter(F.col("__left").isNotNull()).alias("p")
    out = out.join(carried.alias("c"), same("p", "c"))
    # a null time stands before all others and takes nothing along
    found = F.when(F.col("p.__t").isNotNull(), F.coalesce("p.__here", "c.__before"))
    return out.select(F.col("p.__left").alias("__left"), found.alias(name)).select(*(F.col("__left")[c].alias(c) for c in left.columns), name)
