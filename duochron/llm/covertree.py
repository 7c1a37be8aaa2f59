"""Exact top-k inner products by dual-tree search over cover trees.

Components are turned into floor(SCALE * x); scores are integers. Rows are dealt out to shards, and each
task joins one shard of candidates with one of queries (a stated query set against all rows, in blocks).
There a cover tree is built over the queries and one over the candidates: a node's points lie within
its covering radius of its centre, and its children are a greedy net of its points at half that radius,
or wider where that would need more than FAN children. Pairs of nodes are visited by falling upper bound

    <q, c> + |q| * R + |c| * r + r * R,

and a pair is pruned when that is below the worst kth score of the query node's group. The best of each
shard are merged by query with a rank.

Defined results: rows without an id, and vectors that are null, empty, or hold null or non-finite components
take no part, nor do such queries; vectors of different lengths are never compared; equal query rows are one
query, and a query's own row is one row equal to it; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duochron.llm.common import arrow_map, partitions

SCALE, LEAF, FAN = 64, 64, 16
#: Rows of a candidate shard and of a query shard, which bound a task's memory.
SHARD, QUERIES = 16_384, 4_096


class Tree:
    """Nodes in arrays: centre, covering radius, and either children or a run of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.norm, self.span, self.children = [], [], [], [], []
        self._build(0, len(x), self.x.mean(0) if len(x) else np.zeros(x.shape[1]))
        self.centre, self.radius, self.norm = np.array(self.centre), np.array(self.radius), np.array(self.norm)

    def _build(self, start: int, end: int, centre: np.ndarray) -> int:
        me = len(self.span)
        points = self.x[self.order[start:end]]
        far = np.sqrt(((points - centre) ** 2).sum(1))
        radius = float(far.max()) if len(far) else 0.0
        self.centre.append(centre)
        self.radius.append(radius)
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.span.append((start, end))
        self.children.append([])
        if end - start <= LEAF or radius == 0:
            return me
        net = [int(far.argmax())]
        near = np.sqrt(((points - points[net[0]]) ** 2).sum(1))
        owner = np.zeros(len(points), np.int64)
        while len(net) < FAN and near.max() > radius / 2:
            net.append(int(near.argmax()))
            d = np.sqrt(((points - points[net[-1]]) ** 2).sum(1))
            owner = np.where(d < near, len(net) - 1, owner)
            near = np.minimum(near, d)
        sort = np.argsort(owner, kind="stable")
        self.order[start:end] = self.order[start:end][sort]
        sizes = np.bincount(owner, minlength=len(net))
        at = start
        for k, size in enumerate(sizes):
            self.children[me].append(self._build(at, at + int(size), points[net[k]]))
            at += int(size)
        return me


def search(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``c`` (or -1) and scores of the k best for every query, ties to the smaller id."""
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), -1, np.int64)
    if not len(c) or not len(q):
        return who, best
    qt, ct = Tree(q), Tree(c)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(c))
    worst = np.full(len(qt.span), -np.inf)

    def bound(a: int, b: int) -> float:
        return float(qt.centre[a] @ ct.centre[b]) + qt.norm[a] * ct.radius[b] + ct.norm[b] * qt.radius[a] + qt.radius[a] * ct.radius[b] + 1e-6 * (1 + qt.norm[a] * ct.norm[b])

    def meet(a: int, b: int) -> None:
        rows = qt.order[slice(*qt.span[a])]
        cols = ct.order[slice(*ct.span[b])]
        score = np.rint(q[rows] @ c[cols].T)
        hit = (score >= best[rows, -1][:, None]).any(1)
        if hit.any():
            r = rows[hit]
            s = np.concatenate([best[r], score[hit]], 1)
            w = np.concatenate([who[r], np.broadcast_to(cols, (len(r), len(cols)))], 1)
            first = np.lexsort((np.where(w < 0, len(c), rank[w]), -s), axis=-1)[:, :k]
            best[r], who[r] = np.take_along_axis(s, first, 1), np.take_along_axis(w, first, 1)
            worst[a] = best[rows, -1].min()

    def visit(a: int, b: int) -> None:
        if bound(a, b) < worst[a]:
            return
        if not qt.children[a] and not ct.children[b]:
            meet(a, b)
            return
        if ct.children[b] and (not qt.children[a] or ct.radius[b] >= qt.radius[a]):
            for _, child in sorted(((bound(a, x), x) for x in ct.children[b]), reverse=True):
                visit(a, child)
        else:
            for child in qt.children[a]:
                worst[child] = max(worst[child], worst[a])
                visit(child, b)
            worst[a] = max(worst[a], min(worst[child] for child in qt.children[a]))

    visit(0, 0)
    return who, best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every query row, its own row left out."""
    spark = vectors.sparkSession
    v = F.col("vector")
    finite = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    finite = finite & F.col("id").isNotNull()
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(finite)
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(finite).distinct()
    shards, groups = max(1, -(-rows.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    here = F.xxhash64("id", "vector")
    c = rows.withColumn("shard", F.pmod(here, F.lit(shards))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("side", F.lit(0))
    q = asked.withColumn("group", F.pmod(here, F.lit(groups))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("side", F.lit(1))
    names = [F.col("shard").cast("int").alias("shard"), F.col("group").cast("int").alias("group"), F.size("vector").alias("d"), "side", "id", "vector"]
    blocks = c.select(*names).unionByName(q.select(*names)).repartition(partitions(spark), "shard", "group", "d").sortWithinPartitions("shard", "group", "d", "side")

    def make():
        def answer(sides) -> Iterator[dict]:
            ids, x = (np.concatenate([p[i] for p in sides[0]]) for i in (0, 1))
            asks, y = (np.concatenate([p[i] for p in sides[1]]) for i in (0, 1))
            who, score = search(y, x, ids, k + 1)
            i, j = np.nonzero(who >= 0)
            w = who[i, j]
            yield {"query_id": asks[i], "hash": np.array([xxhash.xxh3_64_intdigest(y[n].tobytes()) - 2**63 for n in range(len(y))], np.int64)[i], "vec_id": ids[w], "score": score[i, j].astype(np.int64), "same": (ids[w] == asks[i]) & (x[w] == y[i]).all(1)}

        def run(batches) -> Iterator[dict]:
            at, sides = None, ([], [])
            for b in batches:
                keys = list(zip(b["shard"].to_pylist(), b["group"].to_pylist(), b["d"].to_pylist(), b["side"].to_pylist(), strict=True))
                cuts = [n for n in range(len(keys)) if n == 0 or keys[n] != keys[n - 1]]
                for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    if at is not None and keys[s][:3] != at:
                        if sides[0] and sides[1]:
                            yield from answer(sides)
                        sides = ([], [])
                    at = keys[s][:3]
                    sides[keys[s][3]].append((b["id"][s:e].to_numpy(), _matrix(b["vector"][s:e])))
            if sides[0] and sides[1]:
                yield from answer(sides)

        return run

    found = arrow_map(blocks, make, "query_id bigint, hash bigint, vec_id bigint, score bigint, same boolean", 4096)
    own = Window.partitionBy("query_id", "hash", "same").orderBy(F.desc("score"), "vec_id")
    best = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("nth", F.row_number().over(own)).where(~(F.col("same") & (F.col("nth") == 1)))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
