"""Row partitionings, ghost sets, balance and communication volume.

An assignment has a row for each global index: g, owner, lidx (the place in
the owner's block).  Ghosts are the entries' columns that another part owns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import block, cyclic, grid
from ..functions.tables import ranked, stored, written
from .components import components
from .matrix import SparseMatrix, adjacency, degrees, row_counts
from .temporal import asof_join

SLACK = 1.10
CHUNKS, AGAIN = 256, 4
#: Levels of the Cuthill-McKee order in one plan.
WINDOW = 16


def assign_cyclic(spark: SparkSession, n: int, parts: int) -> DataFrame:
    owner, local = cyclic(F.col("g"), parts)
    return spark.range(n).select(F.col("id").alias("g")).select("g", owner.alias("owner"), local.alias("lidx"))


def assign_block(spark: SparkSession, n: int, parts: int) -> DataFrame:
    owner, local = block(F.col("g"), n, parts)
    return spark.range(n).select(F.col("id").alias("g")).select("g", owner.alias("owner"), local.alias("lidx"))


def shards(entries: DataFrame, parts: int) -> DataFrame:
    """Rows dealt in turn: part, local row, global column, value."""
    p, li = cyclic(F.col("i"), parts)
    return entries.select(p.alias("p"), li.alias("li"), "j", "v")


def mapped_shards(entries: DataFrame, assignment: DataFrame) -> DataFrame:
    a = assignment.select(F.col("g").alias("i"), F.col("owner").alias("p"), F.col("lidx").alias("li"))
    return entries.join(a, "i").select("p", "li", "j", "v")


def checkerboard(entries: DataFrame, parts: int) -> DataFrame:
    """Both dimensions dealt in turn over the process grid."""
    rows, cols = grid(parts)
    pr, li = cyclic(F.col("i"), rows)
    pc, lj = cyclic(F.col("j"), cols)
    return entries.select(pr.alias("pr"), pc.alias("pc"), li.alias("li"), lj.alias("lj"), "v")


# ghosts


def _remote(entries: DataFrame, parts: int) -> DataFrame:
    """Distinct remote columns of each part: p, owner, lidx at the owner."""
    p, _ = cyclic(F.col("i"), parts)
    owner, lidx = cyclic(F.col("j"), parts)
    return entries.select(p.alias("p"), owner.alias("owner"), lidx.alias("lidx")).filter("p <> owner").distinct()


def ghost_need(entries: DataFrame, parts: int) -> DataFrame:
    """Distinct remote columns of each part, and the slot among p's ghosts in
    the order of owner and lidx.  Parts are few and large: slots are ranked."""
    slots = ranked(_remote(entries, parts), [F.col("owner"), F.col("lidx")], "slot", by=("p",))
    return slots.withColumn("slot", F.col("slot").cast("int"))


def ghost_counts(entries: DataFrame, parts: int) -> DataFrame:
    need = _remote(entries, parts).groupBy("p", "owner").agg(F.count("*").alias("n"))
    before = W.partitionBy("p").orderBy("owner").rowsBetween(W.unboundedPreceding, -1)  # a row for each pair of parts
    return need.withColumn("displacement", F.coalesce(F.sum("n").over(before), F.lit(0)))


def ghost_requests(entries: DataFrame, parts: int) -> DataFrame:
    """What each owner is asked for: the need, seen from the other side."""
    return _remote(entries, parts).select(F.col("owner").alias("p"), F.col("p").alias("requester"), "lidx")


def compact_columns(m: SparseMatrix, parts: int) -> DataFrame:
    """Entries with columns renumbered: owned ones first, then the ghosts."""
    m.square()
    p, li = cyclic(F.col("i"), parts)
    owner, lidx = cyclic(F.col("j"), parts)
    mine = m.df.select(p.alias("p"), li.alias("li"), owner.alias("owner"), lidx.alias("lidx"), "v")
    rows = F.floor(F.lit(m.nrows) / parts) + (F.col("p") < m.nrows % parts).cast("int")
    both = mine.join(ghost_need(m.df, parts), ["p", "owner", "lidx"], "left")
    return both.select("p", "li", F.when(F.col("p") == F.col("owner"), F.col("lidx")).otherwise(rows + F.col("slot")).cast("long").alias("col"), "v")


# balance and volume


def load_balance(m: SparseMatrix, parts_list: tuple[int, ...]) -> DataFrame:
    """Entries of the parts, in one and two dimensions: min, average, max,
    sample deviation and ratios.  Parts without entries count as 0.  All
    partitionings are counted in one scan."""
    spark, at, every = m.df.sparkSession, [], []
    for parts in parts_list:
        rows, cols = grid(parts)
        one = cyclic(F.col("i"), parts)[0]
        two = cyclic(F.col("i"), rows)[0] * cols + cyclic(F.col("j"), cols)[0]
        for family, p in (("1d_cyclic", one), ("2d_checkerboard", two)):
            at.append(F.struct(F.lit(family).alias("family"), F.lit(parts).alias("P"), p.cast("int").alias("part")))
            every += [(family, parts, k) for k in range(parts)]
    per = m.df.select(F.inline(F.array(*at))).groupBy("family", "P", "part").agg(F.count("*").alias("nnz"))
    per = spark.createDataFrame(every, "family string, P int, part int").join(per, ["family", "P", "part"], "left").select("family", "P", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    s = per.groupBy("family", "P").agg(F.min("nnz").alias("nnz_min"), F.avg("nnz").alias("nnz_avg"), F.max("nnz").alias("nnz_max"), F.coalesce(F.stddev_samp("nnz"), F.lit(0.0)).alias("nnz_stdev"))
    return s.select("*", F.try_divide("nnz_max", "nnz_avg").alias("max_over_avg"), F.try_divide("nnz_max", "nnz_min").alias("max_over_min"))


def comm_volume(m: SparseMatrix, parts_list: tuple[int, ...]) -> DataFrame:
    """Mean bytes that a part moves each product: the whole x under full
    broadcast, its ghosts, and its segments of x and y on the checkerboard; parts
    of one move their own x and y too.  The ghosts of all partitionings are
    counted in one scan."""
    # over the parts of a grid, the mean of a segment is the dimension's share
    grids = {parts: grid(parts) for parts in parts_list}
    plain = [(parts, 4.0 * m.ncols, 4.0 * (m.ncols / cols + m.nrows / rows)) for parts, (rows, cols) in grids.items()]
    at = [F.struct(F.lit(parts).alias("P"), cyclic(F.col("i"), parts)[0].alias("part"), cyclic(F.col("j"), parts)[0].alias("owner")) for parts in parts_list]
    need = m.df.select("j", F.inline(F.array(*at))).filter("part <> owner").select("P", "part", "j").distinct().groupBy("P").agg(F.count("*").alias("n"))
    out = m.df.sparkSession.createDataFrame(plain, "P int, naive_bytes double, checkerboard_bytes double").join(need, "P", "left")
    out = out.select("P", "naive_bytes", (F.coalesce("n", F.lit(0)) * 4.0 / F.col("P")).alias("ghost_bytes"), "checkerboard_bytes")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.select("*", ratio("ghost_bytes", "naive_bytes").alias("ghost_over_naive"), ratio("checkerboard_bytes", "naive_bytes").alias("checkerboard_over_naive"), ratio("checkerboard_bytes", "ghost_bytes").alias("checkerboard_over_ghost"))


# splits and orders


def balanced_split(rows: DataFrame, n: int, parts: int, order: list[Column]) -> tuple[DataFrame, list[int]]:
    """Contiguous blocks of about equal entries in the given order of ``rows``
    (g, nnz): rows with pos, and the blocks' starts.  Block r ends at the first
    position whose entries before reach r + 1 shares; each block has a row at
    least, as far as there are rows."""
    placed = written(ranked(ranked(rows, order, "pos"), [F.col("pos")], "before", F.col("nnz")), "split")
    total = placed.agg(F.sum("nnz")).first()[0] or 0
    share = total // parts
    ends = placed.agg(*(F.count_if(F.col("before") < share * (r + 1)).alias(f"e{r}") for r in range(parts))).first()
    starts = [0]
    for r in range(parts - 1):
        starts.append(min(n, max(ends[r], starts[-1] + 1)))
    return placed, [*starts, n]


def split_assignment(placed: DataFrame, starts: list[int]) -> DataFrame:
    owner = F.lit(0)
    for s in starts[1:-1]:
        owner = owner + (F.col("pos") >= s).cast("int")
    start = F.element_at(F.array(*map(F.lit, starts)), owner + 1)
    return placed.select("g", owner.alias("owner"), (F.col("pos") - start).cast("long").alias("lidx"), "pos")


def _vertices(m: SparseMatrix) -> DataFrame:
    """g, nnz (0 if the row is empty) and degree of every row."""
    g = m.df.sparkSession.range(m.nrows).select(F.col("id").alias("g"))
    return g.join(row_counts(m.df).withColumnRenamed("i", "g"), "g", "left").join(degrees(m.df).withColumnRenamed("u", "g"), "g", "left").select("g", F.coalesce("nnz", F.lit(0)).alias("nnz"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _walks(edges: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vertices with two neighbours that are not in ``stops`` (g), and the
    walks over them: every edge (u, v) into one is followed until a vertex that
    is none.  Of a walk: its last edge (x, b), ``steps`` after the first, and
    whether u is such a vertex (``inner``); b is null on a ring, and ``low`` is
    the ring's least vertex.

    Walks double their lengths in every round; only the unfinished take part."""
    through = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n = 2").select(F.col("u").alias("g"), "lo", "hi")
    if stops is not None:
        through = through.join(stops.select("g"), "g", "left_anti")
    through = written(through, "rcm-through")
    there = lambda c: through.select(F.col("g").alias(c), F.lit(True).alias(f"is_{c}"))
    both = through.select(F.inline(F.array(F.struct(F.col("lo").alias("u"), F.col("g").alias("v"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("u"), F.col("g").alias("v"), F.col("lo").alias("b")))))
    both = both.join(there("u"), "u", "left").join(there("b"), "b", "left")
    walks = both.select("u", "v", F.col("v").alias("x"), "b", F.lit(1).cast("long").alias("steps"), F.coalesce("is_u", F.lit(False)).alias("inner"), F.least("v", F.when(F.col("is_b"), F.col("b"))).alias("low"), F.col("is_b").isNull().alias("done"))
    schema, spark = walks.schema, edges.sparkSession
    done, left, length, most = [], stored(walks, "rcm-walks"), 1, through.count()
    while True:
        now = spark.read.schema(schema).parquet(left)
        done.append(stored(now.filter("done"), "rcm-walked"))
        open_ = now.filter("NOT done")
        # no walk but a ring's passes more vertices than there are
        if length > most or open_.isEmpty():
            rings = open_.withColumn("b", F.lit(None).cast("long"))
            return through.select("g"), written(spark.read.schema(schema).parquet(*done).unionByName(rings).drop("done"), "rcm-walked")
        known = spark.read.schema(schema).parquet(left, *done[:-1])
        nxt = known.select(F.col("u").alias("x"), F.col("v").alias("b"), F.col("x").alias("x2"), F.col("b").alias("b2"), F.col("steps").alias("more"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        far = open_.join(nxt, ["x", "b"]).select("u", "v", F.col("x2").alias("x"), F.col("b2").alias("b"), (F.col("steps") + F.col("more")).alias("steps"), "inner", F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        left, length = stored(far, "rcm-walks"), 2 * length


def _links(edges: DataFrame, through: DataFrame, walks: DataFrame) -> DataFrame:
    """The graph of the other vertices: a, b, the length, and the first vertex f
    after a of every walk from one to the next, in both directions."""
    mid = lambda c: through.select(F.col("g").alias(c))
    plain = edges.join(mid("u"), "u", "left_anti").join(mid("v"), "v", "left_anti").select(F.col("u").alias("a"), F.col("v").alias("f"), F.col("v").alias("b"), F.lit(1).cast("long").alias("len"))
    return plain.unionByName(walks.filter("NOT inner").select(F.col("u").alias("a"), F.col("v").alias("f"), "b", (F.col("steps") + 1).alias("len")))


def rcm_order(m: SparseMatrix, window: int = WINDOW) -> DataFrame:
    """g and pos in the reverse Cuthill-McKee order, ties by (degree, index).

    Every component starts from its least (degree, index); the next level's
    vertices come by their first parent's position, then degree, then index.
    Components follow each other by their starts, and the whole is reversed.

    Vertices of a level are in the order of their paths from the start, a path
    being (degree, index) of the vertices on it.  So a vertex's label is the
    least (level, path), and no positions are needed on the way.  Where a vertex
    has two neighbours the path has no choice: such chains are links with a
    length.  One plan takes several levels (windows grow up to ``window``); a
    vertex hands its label on when its level is reached, once.  Between windows
    the paths of the links that cross over become numbers in their order, so
    that paths stay short.  The vertices of a chain come at the end, as of the
    last number of their link."""
    m.square()
    nodes = written(_vertices(m), "rcm-nodes")
    edges = written(adjacency(m.df), "rcm-edges")
    through, walks = _walks(edges)
    comps = components(_links(edges, through, walks).select("a", "b")).select(F.col("node").alias("b"), "label")
    inside = walks.join(comps, "b", "left").groupBy(F.col("v").alias("g")).agg(F.min(F.coalesce("label", "low")).alias("label"))
    label = comps.withColumnRenamed("b", "g").unionByName(inside)
    starts = nodes.join(label, "g", "left").groupBy(F.coalesce("label", "g").alias("c")).agg(F.min(F.struct("degree", "g")).alias("s")).select("s.degree", "s.g")
    starts = written(ranked(starts, [F.col("degree"), F.col("g")], "part").select("g", "part"), "rcm-starts")
    if not starts.join(through, "g", "left_semi").isEmpty():
        through, walks = _walks(edges, starts)
    links = written(_links(edges, through, walks).join(nodes.select(F.col("g").alias("f"), "degree"), "f"), "rcm-links")

    none = F.array().cast("array<bigint>")
    step = F.concat("key", F.array("degree", "f"))
    fresh = starts.select("g", F.lit(0).cast("long").alias("level"), none.alias("key"), "part")
    schema, spark = fresh.schema, nodes.sparkSession
    settled, records, going = [stored(fresh, "rcm-level")], [], None
    all_settled = lambda: spark.read.schema(schema).parquet(*settled)
    # links among vertices without a label, and each with itself to keep labels
    rest = nodes.select("g").join(through, "g", "left_anti")
    live = links.unionByName(rest.select(F.lit(None).cast("long").alias("f"), F.col("g").alias("a"), F.col("g").alias("b"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("long").alias("degree")))
    end, width = 0, 1
    while True:
        fresh = spark.read.schema(schema).parquet(settled[-1])
        out = links.join(fresh, F.col("a") == F.col("g")).select("a", "f", "b", "len", F.col("level").alias("from"), step.alias("key"), "part")
        out = written(out, "rcm-out")
        records.append(out.filter((F.col("len") > 1) & (F.col("from") < end)).select("a", "f", (F.col("from") + 1).alias("since"), "key"))
        cross = (out if going is None else out.unionByName(going)).filter(F.col("from") + F.col("len") > end)
        seen = all_settled().select(F.col("g").alias("b"), F.lit(True).alias("seen"))
        cross = cross.join(seen, "b", "left").filter("seen IS NULL OR len > 1")
        cross = ranked(cross, [F.col("part"), F.col("key")], "at").withColumn("key", F.array("at")).withColumn("arrive", F.col("from") + F.col("len"))
        cross = written(cross.drop("at"), "rcm-cross")
        records.append(cross.filter("len > 1").select("a", "f", F.lit(end + 1).cast("long").alias("since"), "key"))
        going = cross.select("a", "f", "b", "len", "from", "key", "part")
        first = cross.filter("seen IS NULL").agg(F.min("arrive")).first()[0]
        if first is None:
            break
        end = first + width
        live = live.join(fresh.select(F.col("g").alias("a")), "a", "left_anti").join(fresh.select(F.col("g").alias("b")), "b", "left_anti")
        live = written(live.repartition("a").select("a", "f", "b", "len", "degree"), "rcm-live")
        best = F.min(F.struct("level", "key", "part")).alias("s")
        state = cross.filter((F.col("arrive") <= end) & F.col("seen").isNull()).select(F.col("b").alias("g"), F.col("arrive").alias("level"), "key", "part").groupBy("g").agg(best).select("g", "s.*")
        for level in range(first, end):
            on = (F.col("g") == F.col("a")) & ((F.col("len") == 0) | ((F.col("level") == level) & (F.col("len") <= end - level)))
            state = state.join(live, on).select(F.col("b").alias("g"), (F.col("level") + F.col("len")).alias("level"), F.when(F.col("len") == 0, F.col("key")).otherwise(step).alias("key"), "part").groupBy("g").agg(best).select("g", "s.*")
        settled.append(stored(state.select(schema.names), "rcm-level"))
        width = min(2 * width, window)

    placed = all_settled()
    inner = walks.select(F.when(F.col("inner"), F.col("u")).otherwise(F.col("v")).alias("g"), F.when(F.col("inner"), F.col("b")).otherwise(F.col("u")).alias("a"), F.when(F.col("inner"), F.col("x")).otherwise(F.col("v")).alias("f"), F.when(F.col("inner"), F.col("steps") + 1).otherwise(F.lit(1)).alias("after"))
    if not through.isEmpty():
        inner = inner.join(placed.select(F.col("g").alias("a"), "level", "part"), "a").withColumn("level", F.col("level") + F.col("after"))
        inner = asof_join(inner, reduce(DataFrame.unionByName, records), "level", "since", by=(("a", "a"), ("f", "f")))
        inner = inner.groupBy("g").agg(F.min(F.struct("level", F.col("matched.key").alias("key"), "part")).alias("s")).select("g", "s.*")
        placed = placed.unionByName(inner)
    placed = ranked(placed, [F.col("part"), F.col("level"), F.col("key")], "forward")
    return placed.select("g", (F.lit(m.nrows - 1) - F.col("forward")).cast("long").alias("pos"))


def assign_rcm(m: SparseMatrix, parts: int) -> tuple[DataFrame, list[int]]:
    order = rcm_order(m)
    rows = order.join(_vertices(m).select("g", "nnz"), "g")
    placed, starts = balanced_split(rows.withColumnRenamed("pos", "__at"), m.nrows, parts, [F.col("__at")])
    return split_assignment(placed, starts), starts


def _admitted(rows: DataFrame, loads: list[float], limits: list[float], scores: str = "scores") -> DataFrame:
    """g, owner and nnz of ``rows`` (g, nnz, turn, scores: one for each part),
    each in the best of its parts that has room.

    In rounds: every vertex left asks for its best open part (ties: the lesser
    load, then by turns, so that equal vertices spread); vertices are admitted in
    the order of ``turn`` as long as the part's limit holds, and a part that had
    to turn vertices away is closed.  The limit is found from sums over
    ``CHUNKS`` ranges of turns, one row for each range and part.  Vertices that
    no limit holds go to the part with the most room."""
    spark, parts = rows.sparkSession, len(loads)
    chunk, room, out = F.floor(F.col("turn") * CHUNKS), [limit - load for limit, load in zip(limits, loads, strict=True)], []
    open_ = [p for p in range(parts) if room[p] > 0]
    left = rows
    while True:
        if not open_:
            open_ = [max(range(parts), key=lambda p: room[p])]
            room[open_[0]] = float("inf")
        even = F.floor(F.col("turn") * 1_000_003 + F.col("g")) % len(open_)
        choices = [F.struct(F.col(scores)[p].alias("s"), F.lit(-float(loads[p])).alias("l"), F.pmod(even + k, F.lit(len(open_))).alias("t"), F.lit(-p).alias("p")) for k, p in enumerate(open_)]
        asks = written(left.withColumn("owner", (-F.array_max(F.array(*choices))["p"]).cast("int")).withColumn("chunk", chunk), "greedy-asks")
        sums: dict[int, list] = {p: [] for p in open_}
        for r in asks.groupBy("owner", "chunk").agg(F.sum("nnz").alias("n")).orderBy("chunk").collect():  # CHUNKS x parts rows
            sums[r["owner"]].append((r["chunk"], r["n"]))
        cut, closed = {}, []
        for p in open_:
            took, upto = 0.0, CHUNKS
            for c, n in sums[p]:
                if took + n > room[p]:
                    upto = c
                    closed.append(p)
                    break
                took += n
            cut[p] = upto
            room[p] -= took
            loads[p] += took
        admit = F.element_at(F.create_map(*(F.lit(x) for kv in cut.items() for x in kv)), F.col("owner"))
        out.append(asks.filter(F.col("chunk") < admit).select("g", "owner", "nnz"))
        if not closed:
            break
        left = asks.filter(F.col("chunk") >= admit).drop("owner", "chunk")
        open_ = [p for p in open_ if p not in closed]
    return reduce(DataFrame.unionByName, out)


def assign_greedy(m: SparseMatrix, parts: int, growth: float = 2.0, passes: int = 1) -> DataFrame:
    """Linear deterministic greedy assignment, in batches.

    Vertices come by falling degree; a vertex goes where most of its placed
    neighbours are, discounted by that part's load against its capacity (1.1
    times the mean entries), ties to the lesser load, then the lower part.  A
    single sequential pass would put the whole graph into one task; here batches
    grow by ``growth`` and all vertices of a batch see the places and loads that
    the batches before left, while each part's share of the batch is bounded
    (``_admitted``).  Then, ``passes`` times, all vertices choose again in
    ``AGAIN`` batches, knowing where all others are.  A part never takes more
    than its capacity, except for rows that no part has room for."""
    m.square()
    spark = m.df.sparkSession
    nodes = ranked(_vertices(m), [F.col("degree").desc(), F.col("g")], "rank")
    ends = [min(m.nrows, 16 * parts)] if m.nrows else []
    while ends and ends[-1] < m.nrows:
        ends.append(min(m.nrows, int(ends[-1] * growth) + 1))
    batch = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        batch = F.when(F.col("rank") < ends[k], k).otherwise(batch)
    nodes = written(nodes.withColumn("batch", batch.cast("int")), "greedy-nodes")
    of = lambda c: nodes.select(F.col("g").alias(c), F.col("batch").alias(f"b{c}"))
    edges = adjacency(m.df).join(of("u"), "u").join(of("v"), "v").withColumn("again", F.pmod(F.xxhash64("u"), F.lit(AGAIN)).cast("int"))
    # by the batch of u, for each batch to read its own
    edges = spark.read.schema(edges.schema).parquet(stored(edges, "greedy-edges", "bu", "again"))
    total = nodes.agg(F.sum("nnz")).first()[0] or 0
    capacity = max(1.0, SLACK * total / parts)
    loads, paths, placed = [0.0] * parts, [], spark.createDataFrame([], "g long, owner int, nnz long")
    scored = lambda some, near: some.join(near, "g", "left").select(
        "g", "nnz", "turn", F.array(*((F.coalesce(F.element_at("near", F.lit(p)), F.lit(0)) * (1 - loads[p] / capacity)) for p in range(parts))).alias("scores"))
    counted = lambda links: links.groupBy("u", "owner").agg(F.count("*").alias("n")).groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("owner", "n"))).alias("near")).withColumnRenamed("u", "g")
    low = 0
    for k, high in enumerate(ends):
        some = nodes.filter(F.col("batch") == k).withColumn("turn", (F.col("rank") - low) / F.lit(high - low))
        weight = some.agg(F.sum("nnz")).first()[0] or 0
        near = counted(edges.filter((F.col("bu") == k) & (F.col("bv") < k)).join(placed.select(F.col("g").alias("v"), "owner"), "v"))
        limits = [SLACK * (sum(loads) + weight) / parts] * parts
        paths.append(stored(_admitted(scored(some, near), loads, limits), "greedy"))
        placed, low = spark.read.schema(placed.schema).parquet(*paths), high
    for _ in range(passes if total else 0):
        for a in range(AGAIN):
            mine = F.pmod(F.xxhash64("g"), F.lit(AGAIN)) == a
            for r in placed.filter(mine).groupBy("owner").agg(F.sum("nnz").alias("n")).collect():  # one row for each part
                loads[r["owner"]] -= r["n"]
            some = nodes.filter(mine).withColumn("turn", F.col("rank") / F.lit(m.nrows))
            near = counted(edges.filter(F.col("again") == a).join(placed.select(F.col("g").alias("v"), "owner"), "v"))
            placed = written(placed.filter(~mine).unionByName(_admitted(scored(some, near), loads, [capacity] * parts)), "greedy")
    return ranked(placed.select("g", "owner"), [F.col("g")], "lidx", by=("owner",)).select("g", "owner", F.col("lidx").cast("long").alias("lidx"))
