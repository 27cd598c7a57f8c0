"""Mixing sources to target weights, with DataFrame functions only.

Method: multivariate-hypergeometric splitting tree.  The documents of a source
are dealt to blocks of about ``BLOCK_DOCS`` by hash.  A source whose target is p
whole passes and a rest takes every block p times and, in the hash order of its
blocks, as many more as fit the rest; of the block that crosses it, the
documents in hash order that fit, and the one that fills the gap best.  These
exact block quotas (of documents that the rest can hold) are split over the
output shards by a binary tree: a node deals half of its block copies to its
left child by draws without replacement over the sources (which is the
multivariate hypergeometric law), the others to the right.  Up to ``URN`` copies
of a source are drawn one by one; of more, the number is one exact draw from the
hypergeometric law by a ratio of uniforms.
Shards then draw disjoint ranges of every source's permuted block copies, and
order their rows by hash.  There are as many shards as hold about
``SHARD_WORDS`` words each, and no fewer than 2 ** ``LEVELS``.

All draws are hashes of names and a seed: reruns agree, whatever the
partitions.  Only the table of sources (one row each) and that of the tree's
nodes meet in one task.  Documents never do: blocks are placed by ranks over the
whole source (``ranked``), and only the documents of one block of each source,
without their texts, are ordered by a window.

Null text has size 0, a null source is a source of its own (the last), rows
with equal ids are separate documents, and an empty table gives an empty mix.
Columns of the input are carried; ``plan`` replaces those named like a computed
one, ``mix`` keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import ranked
from .common import load, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_DOCS = 64
LEVELS, SHARD_WORDS = 4, 4_000_000
URN = 1024
TRIES = 64
SPREAD = 5
TURNS = 3
SEED = 20240917

KEY = ["__s", "__n"]


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _h(*cols: Column | str | int) -> Column:
    return F.xxhash64(F.lit(SEED), *(F.lit(c) if isinstance(c, int) else F.lit(c) if isinstance(c, str) else c for c in cols))


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: docs, source_size, weight and target.

    The fixed point of "cap at MOST times the size, share the excess by weight"
    fills sources in the order of cap / weight: a source is capped as long as
    the share of what is left reaches its cap."""
    per = sized.groupBy(*KEY).agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    k = F.row_number().over(W.orderBy(F.col("__n"), F.col("__s"))) - 1
    weights = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("weight", F.element_at(weights, (k % len(WEIGHTS) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("__n"), F.col("__s"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(after))
    # the first source that its share does not fill sets the level of all later ones
    open_ = F.col("level") * F.col("weight") < F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("__n"), F.col("__s"), F.col("level")))).over(W.partitionBy())
    per = per.withColumn("__level", level["level"])
    per = per.select(*KEY, "docs", "source_size", "weight", F.when(F.col("__level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("__level") * F.col("weight"))).alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return per.withColumn("passes", passes).withColumn("need", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))


def _blocks(sized: DataFrame, per: DataFrame) -> DataFrame:
    """One row for each block: how often it is taken whole, and the words that
    its hash-ordered documents still give (``rest``, null if none)."""
    b = sized.groupBy(*KEY, "__block").agg(F.sum(F.when(F.col("__size") <= F.col("need"), F.col("__size")).otherwise(0)).alias("words"))
    b = b.join(per.select(*KEY, "passes", "need"), KEY)
    b = ranked(b, [_h("block", F.col("__s"), F.col("__n"), F.col("__block")), F.col("__block")], "before", F.col("words"), by=tuple(KEY))
    whole = ((F.col("before") + F.col("words") <= F.col("need")) & (F.col("words") > 0)).cast("int")
    crosses = (F.col("before") + F.col("words") > F.col("need")) & (F.col("before") < F.col("need"))
    return b.select(*KEY, "__block", F.col("passes").alias("__passes"), whole.alias("__more"), (F.col("passes") + whole).alias("whole"), F.when(crosses, F.col("need") - F.col("before")).alias("rest"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _log_factorial(n: Column) -> Column:
    """ln n!, to ten digits: Stirling's series from n + 8 on, less the factors."""

    def value(x: Column) -> Column:  # n + 9
        series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
        factors = x - 8.0
        for k in range(1, 8):
            factors = factors * (x - float(k))
        return series - F.log(factors)

    return _let(n + 9.0, value)


def _many(q: Column, left: Column, room: Column, uniform: Callable[..., Column]) -> Column:
    """How many of ``q`` copies go to the ``left`` of ``room`` places: one exact
    hypergeometric draw by a ratio of uniforms.  Of the candidates, drawn under a
    hat that holds the law, the first that lies under it counts (each does with a
    probability of over two thirds; after ``TRIES`` in vain, some 1e-30, the
    law's mode).  Logarithms of factorials stand for the law's weights."""

    def weight(p: Column, z: Column) -> Column:
        return _log_factorial(z) + _log_factorial(p["good"] - z) + _log_factorial(p["m"] - z) + _log_factorial(p["other"] - p["m"] + z)

    def shape(p: Column) -> Column:
        share = p["good"] / room
        spread = F.sqrt((room - p["m"]) * q * share * (1 - share) / F.greatest(room - 1, F.lit(1)) + 0.5)
        # fixed values of the hat: 2 sqrt(2/e) and 3 - 2 sqrt(3/e)
        width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
        mode = F.floor((p["m"] + 1.0) * (p["good"] + 1.0) / (room + 2.0))
        return F.struct(p["m"].alias("m"), p["good"].alias("good"), p["other"].alias("other"), (p["m"] * share + 0.5).alias("middle"), width.alias("width"), mode.alias("mode"))

    def drawn(p: Column, top: Column) -> Column:
        def attempt(found: Column, k: Column) -> Column:
            candidate = _let(F.greatest(uniform("u", k), F.lit(2.0**-31)), lambda u: F.struct(u.alias("u"), (p["middle"] + p["width"] * (uniform("v", k) - 0.5) / u).alias("w")))
            inside = lambda c: (c["w"] >= 0) & (c["w"] < F.least(p["m"], p["good"]) + 1)
            under = lambda c: _let(F.floor(c["w"]), lambda z: F.when(2 * F.log(c["u"]) <= top - weight(p, z), z))
            return F.when(found.isNotNull(), found).otherwise(_let(candidate, lambda c: F.when(inside(c), under(c))))

        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), attempt), p["mode"])

    def back(p: Column, z: Column) -> Column:
        z = F.when(left > room - left, p["m"] - z).otherwise(z)  # the other places were counted
        return F.when(q > room - q, left - z).otherwise(z).cast("long")  # the copies that are not drawn were

    sides = F.struct(F.least(q, room - q).alias("m"), F.least(left, room - left).alias("good"), F.greatest(left, room - left).alias("other"))
    return _let(_let(sides, shape), lambda p: _let(_let(weight(p, p["mode"]), lambda top: drawn(p, top)), lambda z: back(p, z)))


def _quotas(copies: DataFrame, levels: int) -> DataFrame:
    """Exact quotas of every source in every shard, by the splitting tree.  The
    nodes of every ``SPREAD`` levels are written and dealt to tasks anew; a node
    knows only the sources that it has copies of."""
    per = copies.groupBy(*KEY).agg(F.count("*").alias("q"))
    nodes = per.agg(F.array_sort(F.collect_list(F.struct(F.col("__n"), F.col("__s"), F.col("q")))).alias("items")).select(F.lit(1).cast("long").alias("node"), "items")
    tasks = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(levels):

        def uniform(*names: Column | str) -> Column:
            return F.pmod(F.xxhash64(F.lit(SEED), F.lit("urn"), F.col("node"), *(F.lit(x) if isinstance(x, str) else x for x in names)), F.lit(1 << 30)) / float(1 << 30)

        def draw(acc: Column, item: Column) -> Column:
            def one(a: Column, i: Column) -> Column:
                hit = F.when(uniform(item["__s"], item["__n"], i) * a["room"] < a["left"], 1).otherwise(0)
                return F.struct((a["took"] + hit).alias("took"), (a["left"] - hit).alias("left"), (a["room"] - 1).alias("room"))

            left, room, q = acc["left"], acc["room"], item["q"]
            start = F.struct(F.lit(0).cast("long").alias("took"), left.alias("left"), room.alias("room"))
            few = F.aggregate(F.when((q > 0) & (q <= URN), F.sequence(F.lit(1).cast("long"), q)).otherwise(F.array().cast("array<bigint>")), start, one)["took"]
            many = _many(q, left, room, lambda *x: uniform(item["__s"], item["__n"], *x))
            took = F.when(q <= URN, few).when((left > 0) & (left < room), many).otherwise(F.least(left, q))
            return F.struct(F.concat(acc["took"], F.array(took)).alias("took"), (left - took).alias("left"), (room - q).alias("room"))

        room = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        nodes = nodes.withColumn("room", room)
        begin = F.struct(F.array().cast("array<bigint>").alias("took"), F.floor(F.col("room") / 2).alias("left"), F.col("room").alias("room"))
        nodes = nodes.withColumn("went", F.aggregate("items", begin, draw)["took"])
        some = lambda items: F.filter(items, lambda x: x["q"] > 0)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), some(F.zip_with("items", "went", lambda x, t: F.struct(x["__n"].alias("__n"), x["__s"].alias("__s"), t.alias("q")))).alias("items")),
            F.struct((F.col("node") * 2 + 1).alias("node"), some(F.zip_with("items", "went", lambda x, t: F.struct(x["__n"].alias("__n"), x["__s"].alias("__s"), (x["q"] - t).alias("q")))).alias("items")),
        )
        nodes = nodes.select(F.explode(halves).alias("half")).select("half.*").filter(F.size("items") > 0)
        if level % SPREAD == SPREAD - 1 and level + 1 < levels:
            nodes = written(nodes.repartition(min(tasks, 1 << level), "node"), "mix-nodes")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.inline("items")).filter("q > 0")


def _planned(docs: DataFrame, levels: int | None, size: Column | None) -> tuple[DataFrame, int]:
    """__doc (the row of ``docs``), __size, __source_size, __target, __copies
    and __shards of each row, and the tree's levels."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sized = docs.select(whole.alias("__doc"), F.col("doc_id").alias("__id"), (n_words() if size is None else size).alias("__size"), F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"))
    per = written(targets(sized.select(*KEY, F.col("__size").alias("size"))), "mix-sources")
    if levels is None:
        words = per.agg(F.sum("target")).first()[0] or 0
        levels = max(LEVELS, math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))
    n_blocks = F.ceil(F.col("docs") / BLOCK_DOCS)
    sized = sized.join(per.select(*KEY, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("need").alias("__need"), n_blocks.alias("__n_blocks")), KEY)
    sized = sized.withColumn("__h", _h("doc", F.col("__id"))).withColumn("__block", F.pmod(_h("deal", F.col("__id")), F.col("__n_blocks")))
    blocks = written(_blocks(sized.select(*KEY, "__block", "__size", F.col("__need").alias("need")), per), "mix-blocks")
    copies = blocks.select(*KEY, "__block", F.explode(F.sequence(F.lit(0), F.col("whole") + F.col("rest").isNotNull().cast("int"))).alias("copy")).filter(F.col("copy") > 0)
    quotas = written(_quotas(copies, levels), "mix-quotas")
    # a shard's places among its source's copies: as many rows as there are copies, joined by place
    ranges = ranked(quotas, [F.col("shard")], "from", F.col("q"), by=tuple(KEY))
    places = ranges.select(*KEY, "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("q") - 1)).alias("__place"))
    copies = ranked(copies, [_h("copy", F.col("__s"), F.col("__n"), F.col("__block"), F.col("copy")), F.col("__block"), F.col("copy")], "__place", by=tuple(KEY))
    dealt = copies.join(places, [*KEY, "__place"])
    dealt = dealt.groupBy(*KEY, "__block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("__shards"))
    blocks = written(blocks.join(dealt, [*KEY, "__block"], "left"), "mix-shards")
    parts = written(_crossing(sized.select(*KEY, "__block", "__id", "__h", "__size"), blocks), "mix-crossing")
    out = sized.join(blocks.select(*KEY, "__block", "__passes", "__more", "__shards"), [*KEY, "__block"])
    # of rows with equal id and size as many take part as were chosen; they are told apart by nothing else
    same = W.partitionBy("__rs", "__rn", "__rid", "__rsize")
    few = out.join(parts.select(*KEY, "__block").distinct(), [*KEY, "__block"], "left_semi")
    most = out.join(parts.select(*KEY, "__block").distinct(), [*KEY, "__block"], "left_anti").withColumn("__part", F.lit(0))
    few = few.select("*", F.col("__s").alias("__rs"), F.col("__n").alias("__rn"), F.col("__id").alias("__rid"), F.col("__size").alias("__rsize"))
    few = few.withColumn("__turn", F.row_number().over(same.orderBy("__h")))
    chosen = parts.select(*KEY, F.col("__id").alias("__cid"), F.col("__size").alias("__csize"), "__chosen")
    few = few.join(chosen, (few["__s"] == chosen["__s"]) & (few["__n"] == chosen["__n"]) & F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__size") == F.col("__csize")), "left").select(*[few[c] for c in few.columns], "__chosen")
    few = few.withColumn("__part", (F.col("__turn") <= F.coalesce("__chosen", F.lit(0))).cast("int"))
    names = [c for c in most.columns if c != "__part"]
    out = most.select(*names, "__part").unionByName(few.select(*names, "__part"))
    # a document larger than the rest of its source takes no part in it
    more = F.when((F.col("__size") > 0) & (F.col("__size") <= F.col("__need")), F.col("__more")).otherwise(0)
    out = out.withColumn("__copies", F.col("__passes") + more + F.col("__part"))
    return out.withColumn("__shards", F.coalesce(F.slice("__shards", F.lit(1), F.col("__copies")), F.array().cast("array<int>"))), levels


def _crossing(sized: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of the block of each source that crosses its rest: how many of the rows
    of each id and size are taken (``__chosen``; 0 too).  Documents come in hash
    order as far as they fit, by turns of those that the gap still holds, and at
    last the one that fills the gap best."""
    out = sized.join(blocks.filter("rest IS NOT NULL").select(*KEY, "__block", "rest"), [*KEY, "__block"])
    block = W.partitionBy(*KEY, "__block")
    order = block.orderBy("__h", "__id", "__size")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn("__k", F.row_number().over(order)).withColumn("__gap", F.col("rest")).withColumn("__part", F.lit(False))
    for _ in range(TURNS):
        able = ~F.col("__part") & (F.col("__size") > 0) & (F.col("__size") <= F.col("__gap"))
        out = out.withColumn("__cum", F.when(able, F.sum(F.when(able, F.col("__size"))).over(upto)))
        fits = F.coalesce(F.col("__cum") <= F.col("__gap"), F.lit(False))
        filled = F.coalesce(F.max(F.when(fits, F.col("__cum"))).over(block), F.lit(0))
        out = out.withColumn("__part", F.col("__part") | fits).withColumn("__gap", F.col("__gap") - filled)
    off = F.abs(F.col("__size") - F.col("__gap"))
    out = out.withColumn("__best", F.min(F.when(~F.col("__part") & (off < F.col("__gap")), F.struct(off.alias("off"), F.col("__k").alias("k")))).over(block)["k"])
    taken = F.col("__part") | F.coalesce(F.col("__best") == F.col("__k"), F.lit(False))
    return out.groupBy(*KEY, "__block", "__id", "__size").agg(F.count_if(taken).alias("__chosen"))


COMPUTED = ("size", "source_size", "target", "n_copies", "shards")


def plan(docs: DataFrame, levels: int | None = None, size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, n_copies and shards (the output
    shard of each copy).  ``size``: a document's words, counted if not given."""
    out, _ = _planned(docs, levels, size)
    made = [F.col(c).alias(n) for c, n in zip(("__size", "__source_size", "__target", "__copies", "__shards"), COMPUTED, strict=True)]
    return out.select(*(F.col("__doc")[c].alias(c) for c in docs.columns if c not in COMPUTED), *made)


def mix(docs: DataFrame, levels: int | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each copy taken,
    dealt to the output shards and shuffled within them."""
    out, levels = _planned(docs, levels, None)
    rows = out.select("__doc", "__id", F.posexplode("__shards").alias("__copy", "__shard"))
    return rows.repartition(1 << levels, "__shard").sortWithinPartitions("__shard", _h("order", F.col("__id"), F.col("__copy"))).select("__doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(load(spark, sf_dir).select("doc_id", "source", n_words().alias("__words")), "mix-sizes")
    out = plan(docs, size=F.col("__words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", "shards")
