"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Method: a token's context is the sum of its ``CONTEXT`` predecessors' vectors,
each times a weight vector of its distance; a word scores by the product of the
context with its own vector, plus a bias.  Items of the model are the most
frequent words (as many as a power of the training tokens, see ``Layout.of``),
``ENDINGS`` groups of the other words by their last two bytes, and the end.
Items are dealt to about as many classes as a class has items; classes have
vectors too.  Both are trained in numpy by noise-contrastive estimation over all
training tokens.  Scoring normalises exactly, by batched matrix products: over
the classes, and over the items of the token's class.  A word that is no item
takes the probability of its ending's group times its smoothed share of the group.

Training in parallel: the corpus decides how many rounds there are and how many
trainers a round has (``schedule``), and documents are dealt to rounds and
trainers by hash, so neither the input's splits nor the cluster's size matter.
In a round every trainer starts from the same parameters and the same Adagrad
state.  Spark then averages the trainers' steps for each parameter with the
squared gradients that they met there as weights: a vector that one trainer alone
has moved keeps its whole step, one that all have moved takes their mean.  Sums
go up a tree of groups of ``FAN`` trainers and blocks of ``BLOCK`` parameters, so
that no task holds more than ``FAN`` blocks.

Counts are exact and over all training documents.  Every batch of rows counts
its words by hash (of 64 bits, the lowest ``BITS`` being its ending), shards of
the hashes add the counts up.  The ``TOP`` most frequent words (a bounded table)
go to every task; rarer ones ask the shards for their counts.

A null text is empty; every text ends with one end token.  Rows with equal ids
are separate documents.  Without any training document the counts are zero and
the scores those of the untrained model.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, lean, load, mix64, pieces, word_hashes, written

TOP = 131_072
FEWEST, GROWTH = 4094, (1.5, 0.45)
BITS = 9
ENDINGS = 1 << BITS
DIMS, CONTEXT = 16, 4
NOISE, BATCH, RATE = 32, 2048, 0.1
#: Most rounds, and the tokens of a trainer in a round: so many, and so many for each parameter.
ROUNDS, TRAINER_TOKENS, PARAMETER_TOKENS = 8, 2_000_000, 8
CHUNK = 65_536  # tokens that a trainer takes up at once
FAN, BLOCK = 64, 1 << 18
SHARD_BYTES, SHARD_ASKS = 50_000_000, 2_000_000
SLOTS = 20  # bits of the table of frequent words


class Layout:
    """The items' numbers: ``words`` frequent words, then the endings, then the
    end; the start stands in contexts only."""

    def __init__(self, words: int):
        self.words, self.end, self.start = words, words + ENDINGS, words + ENDINGS + 1
        self.items = self.end + 1
        self.classes = 1 << max(6, round(np.log2(self.items) / 2))
        #: Dealt to the classes by turns, so that each has frequent ones.
        self.class_of = (np.arange(self.items) % self.classes).astype(np.int32)

    @classmethod
    def of(cls, tokens: int) -> Layout:
        """Items grow with the corpus, more slowly than it: 4,094 up to 4e7
        training tokens, 35,000 at 5e9, 1.3 million (some 170 MB of parameters)
        at 1.6e13."""
        return cls(int(max(FEWEST, GROWTH[0] * tokens ** GROWTH[1])))


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row, and each word's hash with its ending."""
    starts, ends, words, hashes = word_hashes(data, offs)
    if not len(hashes):
        return words, hashes
    fold = _FOLD[data]
    last = fold[ends - 1].astype(np.uint64) << np.uint64(8) | np.where(ends - starts > 1, fold[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    ending = mix64(last + np.uint64(1)) & np.uint64(ENDINGS - 1)
    return words, hashes & ~np.uint64(ENDINGS - 1) | ending


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Frequent:
    """The most frequent words' ranks and counts by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.key, self.rank = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
        ranks = np.arange(len(hashes), dtype=np.int32)
        self.key[slot[::-1]], self.rank[slot[::-1]] = hashes[::-1], ranks[::-1]
        rest = np.flatnonzero(self.rank[slot] != ranks)
        order = np.argsort(hashes[rest])
        self.more, self.more_rank = hashes[rest][order], ranks[rest][order]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for those that aren't in the table."""
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.where(self.key[slot] == hashes, self.rank[slot], np.int32(-1))
        if len(self.more):
            miss = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.more, hashes[miss]), len(self.more) - 1)
            hit = self.more[at] == hashes[miss]
            out[miss[hit]] = self.more_rank[at[hit]]
        return out


def tokens(data: np.ndarray, offs: np.ndarray, frequent: Frequent, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a piece with an end after each row: hashes (0 for an end),
    ranks (-2 for an end), items, and where each row begins."""
    words, hashes = word_keys(data, offs)
    begin = np.concatenate([[0], np.cumsum(words + 1)])
    inner = np.ones(int(begin[-1]), bool)
    inner[begin[1:] - 1] = False
    every = np.zeros(len(inner), np.uint64)
    every[inner] = hashes
    rank = np.full(len(inner), -2, np.int32)
    rank[inner] = frequent.ranks(hashes)
    ending = layout.words + (every & np.uint64(ENDINGS - 1)).astype(np.int32)
    item = np.where((rank < 0) | (rank >= layout.words), ending, rank)
    item[~inner] = layout.end
    return every, rank, item, begin


def contexts(item: np.ndarray, begin: np.ndarray, layout: Layout) -> np.ndarray:
    """The preceding items of every token, nearest first; a start before a row."""
    n = len(item)
    out = np.full((CONTEXT, n), layout.start, np.int32)
    first = np.repeat(begin[:-1], np.diff(begin))
    at = np.arange(n)
    for j in range(CONTEXT):
        out[j, j + 1 :] = np.where(at[j + 1 :] - j - 1 >= first[j + 1 :], item[: n - j - 1] if j + 1 < n else item[:0], layout.start)
    return out


class Model:
    """Parameters, as one vector of float32 for Spark to average."""

    def __init__(self, flat: np.ndarray, layout: Layout):
        self.flat, self.layout, at = flat, layout, 0
        for name, shape in self.shapes(layout):
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(layout: Layout) -> tuple:
        items, classes = layout.items, layout.classes
        return ("context", (items + 1, DIMS)), ("place", (CONTEXT, DIMS)), ("word", (items, DIMS)), ("bias", (items,)), ("group", (classes, DIMS)), ("group_bias", (classes,))

    @classmethod
    def size(cls, layout: Layout) -> int:
        return sum(int(np.prod(s)) for _, s in cls.shapes(layout))

    @classmethod
    def start(cls, unigram: np.ndarray, layout: Layout) -> Model:
        """Biases from the counts, random context vectors: before training it
        is the unigram model."""
        m = cls(np.zeros(cls.size(layout), np.float32), layout)
        rng = np.random.default_rng(11)
        m.context[:] = rng.normal(0, 0.3, m.context.shape)
        m.place[:] = 1.0 / np.arange(1, CONTEXT + 1)[:, None] ** 0.5
        m.bias[:] = np.log(unigram)
        m.group_bias[:] = np.log(np.bincount(layout.class_of, unigram, layout.classes))
        return m

    def hidden(self, context: np.ndarray) -> np.ndarray:
        q = self.context[context[0]] * self.place[0]
        for j in range(1, CONTEXT):
            q += self.context[context[j]] * self.place[j]
        return q

    def scores(self, context: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the items, exactly normalised."""
        cls, out, n = self.layout.class_of, np.empty(len(item)), self.layout.classes
        for a in range(0, len(item), 32_768):
            some = item[a : a + 32_768]
            q = self.hidden(context[:, a : a + 32_768])
            g = cls[some]
            s = q @ self.group.T + self.group_bias
            part = s[np.arange(len(some)), g] - _lse(s)
            order = np.argsort(g, kind="stable")
            cut = np.searchsorted(g[order], np.arange(n + 1))
            for c in range(n):
                rows = order[cut[c] : cut[c + 1]]
                if len(rows):
                    w = q[rows] @ self.word[c::n].T + self.bias[c::n]
                    part[rows] += w[np.arange(len(rows)), some[rows] // n] - _lse(w)
            out[a : a + len(some)] = part
        return out


def _lse(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


class Trainer:
    """Noise-contrastive estimation of items and classes, with Adagrad."""

    def __init__(self, model: Model, past: np.ndarray, unigram: np.ndarray, seed: int = 5):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.past = Model(past, model.layout)
        self.noise = (np.log(NOISE * unigram).astype(np.float32), np.cumsum(unigram))
        groups = np.bincount(model.layout.class_of, unigram, model.layout.classes)
        self.group_noise = (np.log(NOISE * groups).astype(np.float32), np.cumsum(groups))
        self.seen = 0

    def _down(self, name: str, rows, grad: np.ndarray) -> None:
        past, own = getattr(self.past, name), getattr(self.m, name)
        past[rows] += grad * grad
        own[rows] -= RATE * grad / np.sqrt(past[rows])

    def _scatter(self, name: str, keys: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        self._down(name, k[at], np.add.reduceat(grad[order], at, axis=0))

    def _contrast(self, q: np.ndarray, target: np.ndarray, vectors: str, bias: str, noise: tuple) -> np.ndarray:
        """One step for the targets against shared noise; the contexts' gradient."""
        log_noise, upto = noise
        v, b = getattr(self.m, vectors), getattr(self.m, bias)
        drawn = np.minimum(np.searchsorted(upto, self.rng.random(NOISE) * upto[-1]), len(upto) - 1)
        good = (q * v[target]).sum(axis=1) + b[target] - log_noise[target]
        bad = q @ v[drawn].T + (b[drawn] - log_noise[drawn])
        g = 1 / (1 + np.exp(-np.clip(good, -30, 30))) - 1
        h = 1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        to_q = g[:, None] * v[target] + h @ v[drawn]
        self._scatter(vectors, np.concatenate([target, drawn.astype(target.dtype)]), np.concatenate([g[:, None] * q, h.T @ q]))
        self._scatter(bias, np.concatenate([target, drawn.astype(target.dtype)]), np.concatenate([g, h.sum(axis=0)]))
        return to_q

    def learn(self, item: np.ndarray, context: np.ndarray) -> None:
        cls = self.m.layout.class_of
        for a in range(0, len(item), BATCH):
            some, near = item[a : a + BATCH], context[:, a : a + BATCH]
            r = self.m.context[near]
            q = (r * self.m.place[:, None, :]).sum(axis=0)
            to_q = self._contrast(q, some, "word", "bias", self.noise)
            to_q += self._contrast(q, cls[some], "group", "group_bias", self.group_noise)
            self._scatter("context", near.reshape(-1), (to_q[None] * self.m.place[:, None, :]).reshape(-1, DIMS))
            self._down("place", slice(None), (to_q[None] * r).sum(axis=1))
            self.seen += len(some)


# counts


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(shards)).astype(np.int32)


def _by_shard(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(where, kind="stable")
    w = where[order]
    cut = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)] if len(w) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(w[a]), order[a:b]


def _added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    h = hashes[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(counts[order], at) if len(at) else counts


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    """The count of every word, packed by shard: shard, hashes, counts."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            for _, _, data, offs in pieces(column(batch, "text")):
                held.append(word_keys(data, offs)[1])
            every = np.concatenate([np.zeros(0, np.uint64), *held])
            h, n = _added(every, np.ones(len(every), np.int64))
            rows = [(s, h[k].tobytes(), n[k].tobytes()) for s, k in _by_shard(_shard(h, shards))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "hashes", "counts"])

    def add(t: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(x.as_py() for x in t.column(c)), k) for c, k in (("hashes", np.uint64), ("counts", np.int64)))
        h, n = _added(h, n)
        return pa.table({"shard": t.column("shard").slice(0, 1), "hashes": pa.array([h.tobytes()]), "counts": pa.array([n.tobytes()])})

    kind = "shard int, hashes binary, counts binary"
    return docs.select("text").mapInArrow(count, kind).groupBy("shard").applyInArrow(add, kind)


def _most_frequent(counts: DataFrame, shards: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``most`` words (each shard gives its share) and their counts."""
    share = -(-most // shards)

    @lean
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, n in zip(column(batch, "hashes"), column(batch, "counts"), strict=True):
                h, n = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                best = np.lexsort((h, -n))[:share]
                rows.append((h[best].tobytes(), n[best].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*rows, strict=True)], names=["h", "n"])

    got = counts.select("hashes", "counts").mapInArrow(top, "h binary, n binary").collect()  # ``most`` words
    h, n = (np.frombuffer(b"".join(bytes(r[c]) for r in got), k) for c, k in (("h", np.uint64), ("n", np.int64)))
    order = np.lexsort((h, -n))[:most]
    return h[order], n[order]


def _endings(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each ending."""

    @lean
    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(ENDINGS), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for h, n in zip(column(batch, "hashes"), column(batch, "counts"), strict=True):
                e = (np.frombuffer(h.as_py(), np.uint64) & np.uint64(ENDINGS - 1)).astype(np.int64)
                total += np.bincount(e, np.frombuffer(n.as_py(), np.int64), ENDINGS)
                words += np.bincount(e, minlength=ENDINGS)
        yield pa.RecordBatch.from_arrays([pa.array(range(ENDINGS), pa.int32()), pa.array(total.astype(np.int64)), pa.array(words)], names=["ending", "total", "words"])

    sums = counts.select("hashes", "counts").mapInArrow(endings, "ending int, total long, words long").groupBy("ending").agg(F.sum("total").alias("total"), F.sum("words").alias("words")).collect()
    total, words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in sums:
        total[r["ending"]], words[r["ending"]] = r["total"], r["words"]
    return total, words


# the model over the table


def schedule(tokens: int, parameters: int) -> tuple[int, int]:
    """Rounds, and trainers of a round."""
    share = max(TRAINER_TOKENS, PARAMETER_TOKENS * parameters)
    rounds = max(1, min(ROUNDS, -(-tokens // share)))
    return rounds, max(1, -(-tokens // (rounds * share)))


_SUMS = "trainer long, block int, steps binary, weights binary, squares binary"


def _averaged(trained: DataFrame, trainers: int, model: Model, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parameters and the state after a round, from the trainers' sums."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        sums = [np.sum([np.frombuffer(x.as_py(), np.float32) for x in t.column(c)], axis=0, dtype=np.float32).tobytes() for c in ("steps", "weights", "squares")]
        return pa.table({"trainer": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("steps", "weights", "squares"), sums, strict=True)}})

    while trainers > 1:
        trained = trained.withColumn("trainer", F.floor(F.col("trainer") / FAN)).groupBy("trainer", "block").applyInArrow(add, _SUMS)
        trainers = -(-trainers // FAN)
    flat, past = model.flat.copy(), past.copy()
    for r in trained.select("block", "steps", "weights", "squares").toLocalIterator():  # the parameters of one model
        at = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(r["steps"]) // 4)
        steps, weights, squares = (np.frombuffer(bytes(r[c]), np.float32) for c in ("steps", "weights", "squares"))
        some = np.maximum(weights, np.float32(1e-30))
        flat[at] += steps / some
        past[at] += squares / some
    return flat, past


def itemised(docs: DataFrame, frequent: Frequent, layout: Layout, rounds: int, trainers: int) -> DataFrame:
    """The training documents as numbers of items, with the round and the trainer
    that each is dealt to; a table, so that the texts are read once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = np.uint16 if layout.items < 1 << 16 else np.uint32

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offs in pieces(column(batch, "text")):
                _, _, item, begin = tokens(data, offs, shared.value, layout)
                rows = np.split(item.astype(kind), begin[1:-1])
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(start, stop - start) for c in ("round", "trainer", "k1", "k2")), pa.array([r.tobytes() for r in rows], pa.binary())], names=["round", "trainer", "k1", "k2", "items"])

    deal = F.pmod(F.xxhash64("k2", "k1"), F.lit(rounds * trainers))
    dealt = docs.select((deal % rounds).cast("int").alias("round"), F.floor(deal / rounds).alias("trainer"), "k1", "k2", "text")
    return written(dealt.mapInArrow(run, "round int, trainer long, k1 long, k2 long, items binary"), "lm-items")


def train(docs: DataFrame, frequent: Frequent, unigram: np.ndarray, layout: Layout, n_tokens: int) -> Model:
    """A model of ``docs`` (k1, k2: what tells rows apart; text)."""
    model = Model.start(unigram, layout)
    past = np.full(len(model.flat), 1.0, np.float32)
    rounds, trainers = schedule(n_tokens, len(model.flat))
    kind = np.uint16 if layout.items < 1 << 16 else np.uint32
    items, sc = itemised(docs, frequent, layout, rounds, trainers), docs.sparkSession.sparkContext
    for r in range(rounds):
        now = sc.broadcast((model.flat, past))

        @lean
        def run(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            def started(name: int) -> Trainer:
                flat, past = now.value
                return Trainer(Model(flat.copy(), layout), past.copy(), unigram, seed=(name << 8) + r)

            def learn(t: Trainer, rows: list[np.ndarray]) -> None:
                begin = np.cumsum([0, *map(len, rows)])
                item = np.concatenate(rows).astype(np.int32)
                t.learn(item, contexts(item, begin, layout))

            def sums(t: Trainer, name: int) -> Iterator[pa.RecordBatch]:
                flat, past = now.value
                for k, at in enumerate(range(0, len(flat), BLOCK)):
                    part = slice(at, at + BLOCK)
                    weight = t.past.flat[part] - past[part]
                    some = [weight * (t.m.flat[part] - flat[part]), weight, weight * weight]
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in some)], names=["trainer", "block", "steps", "weights", "squares"])

            name, t, held, size = None, None, [], 0
            for batch in batches:
                for who, row in zip(column(batch, "trainer").to_pylist(), column(batch, "items"), strict=True):
                    if who != name:
                        if t is not None:
                            if held:
                                learn(t, held)
                            yield from sums(t, name)
                        name, t, held, size = who, started(who), [], 0
                    held.append(np.frombuffer(row.as_py(), kind))
                    size += len(held[-1])
                    if size >= CHUNK:
                        learn(t, held)
                        held, size = [], 0
            if t is not None:
                if held:
                    learn(t, held)
                yield from sums(t, name)

        share = items.filter(F.col("round") == r).repartition(trainers, "trainer").sortWithinPartitions("trainer", "k1", "k2").select("trainer", "items")
        flat, past = _averaged(share.mapInArrow(run, _SUMS), trainers, model, past)
        model = Model(flat, layout)
    return model


def score(docs: DataFrame, training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score;
    ``training``: which rows the model learns from."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), (~training).alias("held_out"), F.xxhash64("doc_id", F.lit("row")).alias("k1"), F.xxhash64(text, F.col("doc_id")).alias("k2"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(~F.col("held_out")).alias("n")).first()
    shards, ends = 1 + int((size["b"] or 0) // SHARD_BYTES), size["n"]
    learnt = rows.filter(~F.col("held_out"))
    counts = written(word_counts(learnt, shards), "lm-counts")
    by_ending, words_of = _endings(counts)
    total, distinct = int(by_ending.sum()), int(words_of.sum())
    n_all, v_all = total + ends, distinct + (ends > 0)
    layout = Layout.of(n_all)
    h, n = _most_frequent(counts, shards, max(TOP, layout.words))
    frequent = Frequent(h, n)
    # tokens and words of each ending that are no items
    of = (h[: layout.words] & np.uint64(ENDINGS - 1)).astype(np.int64)
    other = by_ending - np.bincount(of, n[: layout.words], ENDINGS).astype(np.int64)
    other_words = words_of - np.bincount(of, minlength=ENDINGS)
    unigram = np.full(layout.items, 1e-6)  # items that no word takes
    unigram[: min(layout.words, len(n))] = n[: layout.words] + 0.5
    unigram[layout.words : layout.end], unigram[layout.end] = other + 0.5, ends + 0.5
    unigram /= unigram.sum()
    model = train(learnt, frequent, unigram, layout, n_all)
    sc = spark.sparkContext
    shared, flat = sc.broadcast(frequent), sc.broadcast(model.flat)
    ln10 = np.log(10)
    base = np.log10(n_all + 0.5 * (v_all + 1))
    rest = np.log10(other + 0.5 * (other_words + 1))
    end_log, end_known = np.log10(ends + 0.5), int(ends > 0)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, f = Model(flat.value, layout), shared.value
        log_counts = np.log10(f.counts + 0.5)
        for batch in batches:
            for start, stop, data, offs in pieces(column(batch, "text")):
                hashes, rank, item, begin = tokens(data, offs, f, layout)
                got = m.scores(contexts(item, begin, layout), item) / ln10
                log_c = np.zeros(len(rank))
                known = rank >= 0
                log_c[known] = log_counts[rank[known]]
                log_c[rank == -2] = end_log
                # of a word that is no item: its share of its ending's, less its count's logarithm if that isn't here
                grouped = (item >= layout.words) & (item < layout.end)
                tail = np.where(grouped, log_c - rest[np.where(grouped, item - layout.words, 0)], 0.0)
                add = lambda x: np.add.reduceat(x, begin[:-1])
                n_tokens = np.diff(begin)
                asks = np.flatnonzero(rank == -1)
                cut = np.searchsorted(asks, begin)
                ask = [hashes[asks[cut[k] : cut[k + 1]]].tobytes() for k in range(stop - start)]
                cols = [pa.array(n_tokens), pa.array(add(known.astype(np.int64)) + end_known), pa.array(add(log_c) - n_tokens * base), pa.array(add(got + tail)), pa.array(ask, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(start, stop - start) for c in ("doc_id", "held_out", "k1", "k2")), *cols], names=["doc_id", "held_out", "k1", "k2", "n_tokens", "known", "base", "score", "ask"])

    scored = written(rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, k1 long, k2 long, n_tokens long, known long, base double, score double, ask binary"), "lm-scored")

    n_asks = (scored.agg(F.sum(F.octet_length("ask"))).first()[0] or 0) // 8
    split = 1 + int(n_asks // shards // SHARD_ASKS)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            asks = [x.as_py() for x in column(batch, "ask")]
            h = np.frombuffer(b"".join(asks), np.uint64)
            row = np.repeat(np.arange(len(asks), dtype=np.int32), [len(x) // 8 for x in asks])
            pack = next(number)
            # a shard's questions are dealt on by more bits of the hash
            cell = _shard(h, shards) * split + (h % np.uint64(split)).astype(np.int32)
            rows = [{"pack": pack, "shard": c // split, "part": c % split, "ask": h[k].tobytes(), "rows": row[k].tobytes()} for c, k in _by_shard(cell)]
            if rows:
                rows[0]["keys"] = np.stack([column(batch, c).to_numpy() for c in ("k1", "k2")], axis=1).tobytes()
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("ask", pa.binary()), ("rows", pa.binary()), ("keys", pa.binary())]))

    asked = scored.filter(F.octet_length("ask") > 0).select("k1", "k2", "ask").mapInArrow(deal, "pack long, shard int, part int, ask binary, rows binary, keys binary")
    held = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))

    def answer(asking: pa.Table, held: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(held.column(c)[0].as_py(), k) if held.num_rows else np.zeros(0, k) for c, k in (("hashes", np.uint64), ("counts", np.int64)))
        out = []
        for r in asking.to_pylist():
            flat, row = np.frombuffer(r["ask"], np.uint64), np.frombuffer(r["rows"], np.int32)
            c = np.zeros(len(flat), np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
                c = np.where(h[at] == flat, n[at], 0)
            some = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # rows stand in order
            out.append({"pack": r["pack"], "keys": r["keys"], "rows": row[some].tobytes(), "logs": np.add.reduceat(np.log10(c + 0.5), some).tobytes(), "found": np.add.reduceat((c > 0).astype(np.int64), some).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("pack", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("logs", pa.binary()), ("found", pa.binary())]))

    def by_row(t: pa.Table) -> pa.Table:
        parts = t.to_pylist()
        keys = np.frombuffer(next(r["keys"] for r in parts if r["keys"] is not None), np.int64).reshape(-1, 2)
        row, logs, found = (np.concatenate([np.frombuffer(r[c], k) for r in parts]) for c, k in (("rows", np.int32), ("logs", np.float64), ("found", np.int64)))
        return pa.table({"k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "logs": pa.array(np.bincount(row, logs, len(keys))), "found": pa.array(np.bincount(row, found, len(keys)).astype(np.int64))})

    answers = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(answer, "pack long, keys binary, rows binary, logs binary, found binary")
    # equal rows ask alike, and get the same answer
    per = answers.groupBy("pack").applyInArrow(by_row, "k1 long, k2 long, logs double, found long").groupBy("k1", "k2").agg(F.max("logs").alias("logs"), F.max("found").alias("found"))
    out = scored.drop("ask").join(per, ["k1", "k2"], "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir)
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1)
