"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

The model's symbols are the HEAD most frequent training tokens and KINDS kinds of all others, told by a
token's last ENDING bytes. With the last symbol u and the class g of the one before it (itself, if it is
among the CLASSES most frequent), a symbol w has the energy (R[u] + S[g]) . Q[w] + b[w]. Normalisers of all
contexts come from batched matrix products, so the probabilities of symbols sum to one; a token outside the
head has the probability of its kind times its smoothed share of the tokens of that kind.

All training documents train it. They are dealt by a hash to shards of about SHARD tokens (at most SHARDS
shards, which then grow), in the order of that hash, so what is learnt depends on the documents and not on
how the input is split. The shards train in ROUNDS rounds; a round's shards begin with the average of the
parameters, weighted by tokens, that the round before it left.

Counts are exact and cover the whole corpus. The most frequent tokens (up to HOT of them, at most HOT_BYTES
bytes long, so that table is bounded) travel to the tasks; the counts of all others are joined by token.

Defined results: a null or empty text is its end token; a null doc_id is never held out; equal rows get
equal scores; only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import arrow_map, fold_words, partitions, release, stage, texts, unstage

HEAD, CLASSES, WIDTH = 4096, 32, 24
KINDS, ENDING = 512, 3
SHARD, SHARDS, ROUNDS = 1 << 20, 1 << 14, 4
HOT, HOT_BYTES = 150_000, 48
BATCH, NOISE, PER_TOKEN, RATE = 8192, 128, 16, 0.15
#: Words that a task counts before it passes them on.
FLUSH = 200_000
END = b""  # no word is empty


def counted(docs: DataFrame) -> DataFrame:
    """``token binary, n``: how often every token is in the texts, ends included (the empty token)."""

    def make():
        def run(batches) -> Iterator[dict]:
            seen: Counter[bytes] = Counter()
            for b in batches:
                for t in b["text"]:
                    seen.update(fold_words(t.as_py()))
                seen[END] += len(b["text"])
                if len(seen) > FLUSH:
                    yield {"token": list(seen), "n": list(seen.values())}
                    seen = Counter()
            if seen:
                yield {"token": list(seen), "n": list(seen.values())}

        return run

    return arrow_map(docs.select("text"), make, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _kind(token: bytes) -> int:
    return zlib.crc32(token[-ENDING:]) % KINDS


def _kind_of(token: str) -> Column:
    """The same for a column."""
    return (F.crc32(F.substring(token, -ENDING, ENDING)) % KINDS).cast("int")


class _Index(dict):
    def __missing__(self, token: bytes) -> int:
        return -1


class Model:
    """hot: tokens by falling frequency, the end first; the first ``head`` of them are symbols of their own, before the kinds.

    rest, rest_distinct: how many tokens, and how many distinct ones, of each kind occur, from which the head's own are taken.
    """

    def __init__(self, hot: list[bytes], counts: list[int], rest: np.ndarray, rest_distinct: np.ndarray):
        self.hot, self.counts = hot, np.array(counts, np.int64)
        self.head = min(HEAD, len(hot))
        self.total, self.distinct = int(rest.sum()), int(rest_distinct.sum())
        kinds = np.fromiter(map(_kind, hot), np.int64, len(hot))
        seen = self.counts[: self.head] > 0
        self.rest = rest - np.bincount(kinds[: self.head], self.counts[: self.head], KINDS).astype(np.int64)
        self.rest_distinct = rest_distinct - np.bincount(kinds[: self.head][seen], minlength=KINDS)
        self.symbol = np.concatenate([np.arange(self.head), self.head + kinds[self.head :]])
        share = np.concatenate([self.counts[: self.head], self.rest]) + 1.0
        self.share = share / share.sum()
        rng = np.random.default_rng(20_101)
        k = self.head + KINDS
        self.r, self.q = (rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32) for _ in range(2))
        self.s = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.b = np.log(self.share).astype(np.float32)
        self.z: np.ndarray | None = None

    def index(self) -> _Index:
        return _Index(zip(self.hot, range(len(self.hot)), strict=True))

    def bare(self) -> "Model":
        """The same without the tokens, which training on symbols doesn't need."""
        other = copy.copy(self)
        other.hot, other.counts, other.symbol = [], self.counts[:0], self.symbol[:0]
        return other

    def symbols(self, places: np.ndarray, tokens: list[bytes], at: np.ndarray) -> np.ndarray:
        """Symbols of places in the hot table; ``tokens`` are those without one, at the positions ``at``."""
        out = self.symbol[places]
        out[at] = self.head + np.fromiter(map(_kind, tokens), np.int64, len(tokens))
        return out

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.s, self.b]

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def contexts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: whole texts one after another, each with its end (0). The last token and the class of the one before; before a text stand ends."""
        last = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
        older = np.concatenate([[0], last[:-1]]) if len(ids) else ids
        older = np.where(last == 0, 0, older)
        return last, np.minimum(older, CLASSES - 1)

    def normalise(self) -> "Model":
        """log of the sum of exp energies for every context, by matrix products."""
        self.z = np.empty((len(self.r), CLASSES), np.float32)
        base = self.r @ self.q.T + self.b
        for g in range(CLASSES):
            turn = self.s[g] @ self.q.T
            for a in range(0, len(base), 1024):
                e = base[a : a + 1024] + turn
                top = e.max(1, keepdims=True)
                e -= top
                np.exp(e, out=e)
                self.z[a : a + 1024, g] = np.log(e.sum(1)) + top[:, 0]
        return self

    def log10(self, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float64)
        last, older = self.contexts(ids)
        for a in range(0, len(ids), 65536):
            u, g, w = last[a : a + 65536], older[a : a + 65536], ids[a : a + 65536]
            h = self.r[u]
            h += self.s[g]
            out[a : a + 65536] = np.einsum("ij,ij->i", h, self.q[w]) + self.b[w] - self.z[u, g]
        return out / math.log(10)


def _add(to: np.ndarray, past: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An AdaGrad step on some rows; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    total = np.add.reduceat(grad[order], first, axis=0)
    rows = rows[first]
    past[rows] += (total * total).mean(-1) if total.ndim > 1 else total * total
    step = rate / np.sqrt(past[rows] + 1e-6)
    to[rows] += total * (step[:, None] if total.ndim > 1 else step)


class Trainer:
    """Noise-contrastive steps: tell BATCH tokens of the corpus from NOISE draws of their frequencies."""

    def __init__(self, model: Model, seed: int):
        self.m = model
        self.past = [np.full(len(x), 1e-2, np.float32) for x in model.parameters()]
        self.rng = np.random.default_rng(seed)
        self.draw = np.cumsum(model.share)
        self.log_share = np.log(model.share * PER_TOKEN).astype(np.float32)

    def step(self, u: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.draw, self.rng.random(NOISE)), len(m.share) - 1)
        h = m.r[u] + m.s[g]
        qw, qn = m.q[w], m.q[noise]
        true = np.einsum("ij,ij->i", h, qw) + m.b[w] - self.log_share[w]
        false = h @ qn.T + (m.b[noise] - self.log_share[noise])
        dt = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        dn = -(PER_TOKEN / NOISE) / (1 + np.exp(-np.clip(false, -30, 30)))
        dh = dt[:, None] * qw + dn @ qn
        scale = np.float32(1 / 64)  # keeps the first AdaGrad steps small
        _add(m.r, self.past[0], u, dh * scale, RATE)
        _add(m.s, self.past[2], g, dh * scale, RATE)
        _add(m.q, self.past[1], np.concatenate([w, noise]), np.concatenate([dt[:, None] * h, dn.T @ h]) * scale, RATE)
        _add(m.b, self.past[3], np.concatenate([w, noise]), np.concatenate([dt, dn.sum(0)]) * scale, RATE / 4)


def _ids(model: Model, index: _Index, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of whole texts with their ends: symbols, places in the hot table (-1: not there), the texts' lengths; and of the tokens not there: positions, texts, tokens."""
    words = [fold_words(t.as_py()) for t in column]
    get = index.__getitem__
    places = np.fromiter((p for w in words for p in (*map(get, w), 0)), np.int64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(places < 0)
    texts_at = np.searchsorted(starts, at, side="right") - 1
    tokens = [words[d][i] for d, i in zip(texts_at.tolist(), (at - starts[texts_at]).tolist(), strict=True)]
    return model.symbols(places, tokens, at), places, sizes, at, texts_at, tokens


def _symbols(docs: DataFrame, model: Model) -> DataFrame:
    """``key, ids``: the hash that deals a document out, and its symbols."""

    def make():
        index = model.index()

        def run(batches) -> Iterator[dict]:
            for b in batches:
                ids, _, sizes, *_ = _ids(model, index, b["text"])
                ends = np.cumsum(sizes)
                ids = ids.astype("<u2").tobytes()
                yield {"key": b["key"], "ids": [ids[2 * a : 2 * z] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]}

        return run

    return arrow_map(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), make, "key bigint, ids binary")


def _round(rows: DataFrame, model: Model, shards: list[int]) -> None:
    """Train on one shard a task (``part``: its place in ``shards``), each from the model as it is, and put the average into the model."""
    flat = np.concatenate([x.ravel() for x in model.parameters()])
    chunks = 16
    wide = -(-len(flat) // chunks)
    start = model.bare()

    def make():
        task = TaskContext.get().partitionId()

        def run(batches) -> Iterator[dict]:
            m, weight, left = copy.deepcopy(start), 0, np.zeros(0, np.int64)
            trainer = Trainer(m, shards[task])
            for b in batches:
                left = np.concatenate([left, *(np.frombuffer(x.as_buffer(), "<u2") for x in b["ids"])]).astype(np.int64)
                last, older = m.contexts(left)
                whole = len(left) // BATCH * BATCH
                for a in range(0, whole, BATCH):
                    trainer.step(last[a : a + BATCH], older[a : a + BATCH], left[a : a + BATCH])
                weight += whole
                left = left[whole:]
            if len(left):
                trainer.step(*m.contexts(left), left)
                weight += len(left)
            if weight:
                got = np.concatenate([x.ravel() for x in m.parameters()])
                yield {"chunk": list(range(chunks)), "task": [task] * chunks, "weight": [float(weight)] * chunks, "data": [got[i * wide : (i + 1) * wide].tobytes() for i in range(chunks)]}

        return run

    def add():
        def run(batches) -> Iterator[dict]:
            total: dict[int, list] = {}
            for b in batches:
                for chunk, weight, data in zip(b["chunk"].to_pylist(), b["weight"].to_pylist(), b["data"], strict=True):
                    x = np.frombuffer(data.as_buffer(), np.float32) * np.float64(weight)
                    if chunk in total:
                        total[chunk][0] += weight
                        total[chunk][1] += x
                    else:
                        total[chunk] = [weight, x]
            if total:
                yield {"chunk": list(total), "weight": [t[0] for t in total.values()], "data": [t[1].tobytes() for t in total.values()]}

        return run

    dealt = rows.repartitionById(len(shards), "part").sortWithinPartitions("key")
    each = arrow_map(dealt.select("ids"), make, "chunk int, task int, weight double, data binary")
    # in the order of the shards, so that sums of floats come out alike
    done = arrow_map(each.repartition(chunks, "chunk").sortWithinPartitions("chunk", "task").select("chunk", "weight", "data"), add, "chunk int, weight double, data binary", 16).collect()  # the model's size, whatever the corpus
    if done:
        model.put(np.concatenate([np.frombuffer(r.data, np.float64) / r.weight for r in sorted(done)]).astype(np.float32))


def _trained(docs: DataFrame, model: Model) -> Model:
    rows = stage(_symbols(docs, model), "symbols")
    shards = min(SHARDS, -(-model.total // SHARD))
    for r in range(min(ROUNDS, shards)):
        mine = list(range(r, shards, ROUNDS))
        shard = F.pmod("key", F.lit(shards))
        _round(rows.where(shard % ROUNDS == r).withColumn("part", F.floor(shard / ROUNDS).cast("int")), model, mine)
    release(docs.sparkSession)
    unstage(rows)
    return model


def fit(docs: DataFrame, train: Column) -> tuple[Model, DataFrame]:
    """The model of the training documents, and the staged counts of all their tokens."""
    rows = texts(docs).where(train)
    counts = stage(counted(rows), "counts")
    release(docs.sparkSession)
    totals = np.zeros((2, KINDS), np.int64)
    for kind, n, distinct in counts.groupBy(_kind_of("token")).agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most KINDS rows
        totals[:, kind] = n, distinct
    ends = counts.where(F.length("token") == 0).select("n").first()
    short = counts.where((F.length("token") > 0) & (F.length("token") <= HOT_BYTES)).withColumn("step", F.floor(F.log2("n") * 16))
    # how many tokens are how frequent (about a thousand steps), and from which step on they fit
    room, least = HOT, 1 << 30
    for step, k in sorted(short.groupBy("step").agg(F.count(F.lit(1))).collect(), reverse=True):
        room -= k
        if room < 0:
            break
        least = step
    found = sorted(short.where(F.col("step") >= least).select("token", "n").collect(), key=lambda r: (-r[1], bytes(r[0])))  # bounded by HOT and HOT_BYTES
    model = Model([END, *(bytes(r[0]) for r in found)], [ends[0] if ends else 0, *(r[1] for r in found)], *totals)
    return _trained(rows, model).normalise(), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by HOT, HOT_BYTES and HEAD

    def make():
        m = shared.value
        task = TaskContext.get().partitionId()
        index = m.index()
        log_count = np.log10(m.counts + 1.0)
        known_hot = m.counts > 0
        whole = math.log10(m.total + m.distinct + 1)
        rest = np.log10(m.rest + m.rest_distinct + 1.0)

        def run(batches) -> Iterator[dict]:
            row = task << 36
            for b in batches:
                ids, places, sizes, missing, texts_at, tokens = _ids(m, index, b["text"])
                starts = np.cumsum(sizes) - sizes
                counted_here = np.where(places >= 0, log_count[places], 0.0)
                base = np.add.reduceat(counted_here, starts) - sizes * whole
                lm = m.log10(ids) + np.where(ids >= m.head, counted_here - rest[np.maximum(ids - m.head, 0)], 0.0)
                known = np.add.reduceat(((places >= 0) & known_hot[places]).astype(np.int64), starts)
                n = len(sizes)
                keys = np.arange(row, row + n)
                row += n
                yield {"key": keys, "doc_id": b["doc_id"], "n_tokens": sizes, "known": known, "base": base, "lm": np.add.reduceat(lm, starts), "token": [None] * n}
                if len(missing):
                    tail = Counter(zip(texts_at.tolist(), tokens, strict=True))
                    yield {"key": [keys[d] for d, _ in tail], "doc_id": [None] * len(tail), "n_tokens": list(tail.values()), "known": [0] * len(tail), "base": [0.0] * len(tail), "lm": [0.0] * len(tail), "token": [t for _, t in tail]}

        return run

    both = stage(arrow_map(texts(docs), make, "key bigint, doc_id bigint, n_tokens bigint, known bigint, base double, lm double, token binary"), "scored")
    release(spark)
    tail = both.where("token is not null").select("key", "token", F.col("n_tokens").alias("times"))
    more = tail.join(counts, "token").groupBy("key").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("l"))
    docs_rows = both.where("token is null").join(more, "key", "left")
    l = F.coalesce("l", F.lit(0.0))
    return docs_rows.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), (F.col("base") + l).alias("base_score"), (F.col("lm") + l).alias("score"))
