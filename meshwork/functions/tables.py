"""Tables in the shared folder, ranks over a whole table, and lookups that no
hot key slows down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one key from which its value is broadcast: at most rows / HOT such keys.
HOT = 100_000

_stored: list[str] = []
_named: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by
    ``spark.checkpoint.dir``.  Where that is unset a temporary folder takes its
    place on one machine (master ``local``); on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; ``clear`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def stored(df: DataFrame, name: str, *parts: str) -> str:
    """Writes ``df`` as a Parquet table, divided by ``parts``; its path."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def bucketed(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``, with as many buckets as
    shuffles have partitions: a join on the keys does not move it.  Its files are
    in the shared folder; ``clear`` drops it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", fresh_path(spark, name)).saveAsTable(table)
    _named.append(table)
    return spark.table(table)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table of ``written`` that nothing needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        mine = [p for p in _stored if path.rstrip("/").endswith(p.split(":", 1)[-1].lstrip("/"))]
        if mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(mine[0])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _stored.remove(mine[0])


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this driver has written so far, when no
    DataFrame of theirs is needed any more; how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_stored)
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def ranked(df: DataFrame, order: list[Column], name: str, weight: Column | None = None, by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """``df`` with ``name``, each row's position (from 0) in the order of the
    whole table, or of its group ``by``; with ``weight`` the sum of the weights
    before it.  ``total`` names a column for the whole table's or group's sum.

    Rows are range-partitioned and sorted; the size of each group in each
    partition is added up over the partitions, and positions within a partition
    are a window over it.  No task holds more than its partition, however large
    a group is.  Nulls in ``by`` are a group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = F.lit(1) if weight is None else weight
    parts = written(df.withColumn("__w", w.cast("long")).repartitionByRange(n, *(F.col(c) for c in by), *order).withColumn("__part", F.spark_partition_id()), "ranked")
    keys = [F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]
    names = [f"__by{k}" for k in range(len(by))]
    sums = parts.groupBy(*keys, F.col("__part").alias("__ranked_part")).agg(F.sum("__w").alias("__sum"))
    before = (W.partitionBy(*names) if by else W.partitionBy()).orderBy("__ranked_part").rowsBetween(W.unboundedPreceding, -1)
    every = [F.sum("__sum").over(W.partitionBy(*names)).alias(total)] if total else []
    sums = sums.select(*names, "__ranked_part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), *every)
    same = F.col("__part") == F.col("__ranked_part")
    for k, c in zip(names, by, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    within = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # without groups there is one row for each partition
    out = parts.join(sums if by else F.broadcast(sums), same)
    return out.withColumn(name, F.col("__before") + F.coalesce(F.sum("__w").over(within), F.lit(0))).drop("__part", "__before", "__w", "__ranked_part", *names)


def hot_keys(df: DataFrame, key: str, most: int = HOT) -> DataFrame:
    """Keys of more than ``most`` rows; there are at most rows / ``most``."""
    return df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(key)


def looked_up(df: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of ``df`` with a table of unique keys.  The values of hot keys
    (of ``df``; found if not given) are broadcast, so that no task gets all
    rows of one key."""
    hot = F.broadcast(hot_keys(df, key) if hot is None else hot)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return df.join(few, key).unionByName(df.join(hot, key, "left_anti").join(table, key))
