"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.tables import hot_keys, looked_up, written


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that it reaches, of links (a, b).

    Each step takes the smallest label among the neighbours, and then the label
    of that label; labels only fall, and the loop ends when none does.  A node
    of very many links, and the label of a giant component, are hot keys: their
    values are broadcast (``looked_up``).  Nodes without links are not in the
    result; links of a node with itself are allowed."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("node")).union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    large = both.count() > tables.HOT  # else no key can be hot
    hubs = written(hot_keys(both, "node"), "hubs") if large else None
    now = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("node")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = (looked_up(both, now, "node", hubs) if large else both.join(now, "node")).groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        step = written(now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = written((looked_up(step, up, "label") if large else step.join(up, "label")).select("node", "was", F.least("label", "up").alias("label")), "labels")
        now = step.select("node", "label")
        if step.filter("label < was").isEmpty():
            return now
