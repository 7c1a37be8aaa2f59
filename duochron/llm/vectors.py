"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Every vector is projected on DIRECTIONS random directions. Around a vector's own value on each of them
lies a window that holds a partner at the threshold with probability HELD; the number of windows that
hold a pair is counted, and pairs that reach the count which keeps RECALL of true pairs are verified by
their cosine in double precision. The first LEAD projections deal vectors out to cells: a vector lives
in one cell and visits those that its windows reach, so each ordered pair meets once. Inside a cell the
vectors are sorted by the first projection, and only a run of them is counted. The cells that a window
reaches end beyond it, so most pairs outside a lead window meet too; the run's window is wider (RUN_REACH),
so that it loses few. At the threshold 0.9993 of pairs are found in the largest cells.

Equal vectors are one class with a weight. A cell with more than CELL vectors is dealt out as pairs of
blocks, so that no task holds more than two blocks, however large a group is.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; equal rows are separate vectors that link with each
other; classes are told apart by a 64-bit hash; only the key and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import arrow_map, partitions, stage, unstage
from duochron.llm.components import components

DIRECTIONS, LEAD, DENSE = 20, 3, 8
#: Windows reach so many standard deviations of the difference of a pair at the threshold.
REACH = 3.2
#: The same for the run of the first projection: a pair outside it isn't counted at all.
RUN_REACH = 3.75
RECALL = 0.999
CELL = 8192


def usable(vector: str):
    """Neither null, empty nor zero, and without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def least_count(n: int = DIRECTIONS, held: float = math.erf(REACH / math.sqrt(2)), recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    tail = 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * held**k * (1 - held) ** (n - k)
        if tail >= recall:
            return k
    return 0


def _directions(d: int) -> np.ndarray:
    return np.random.default_rng((50_021, d)).standard_normal((d, DIRECTIONS))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _visits(classes: DataFrame, threshold: float) -> DataFrame:
    """``cell, home, uid, n, vector``: each class once at home and in every cell that its windows reach."""
    window = REACH * math.sqrt(2 - 2 * threshold)

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                sizes = np.array([len(v) for v in b["vector"]])
                for d in np.unique(sizes):
                    take = pa.array(np.flatnonzero(sizes == d))
                    part = {k: v.take(take) for k, v in b.items()}
                    p = (_units(_matrix(part["vector"])) @ _directions(int(d)))[:, :LEAD]
                    width = 2 * window
                    home, low, high = (np.floor((p + s) / width).astype(np.int64) for s in (0, -window, window))
                    for corner in range(2**LEAD):
                        up = np.array([corner >> k & 1 for k in range(LEAD)], bool)
                        cell = np.where(up, high, low)
                        new = np.all(~up | (high > low), axis=1)
                        key = ((cell[:, 0] * 1009 + cell[:, 1]) * 1009 + cell[:, 2]) * 100_003 + d
                        i = pa.array(np.flatnonzero(new))
                        yield {"cell": key[new], "home": (cell == home).all(1)[new], "uid": part["uid"].take(i), "n": part["n"].take(i), "vector": part["vector"].take(i)}

        return run

    return arrow_map(classes, make, f"cell bigint, home boolean, uid bigint, n bigint, vector {dict(classes.dtypes)['vector']}", 2048)


def _in_cell(homes: tuple, visitors: tuple, threshold: float) -> dict:
    """Links of visitors with homes: ``uid, links`` and as ``other`` the root of its component here.

    Linked homes say theirs too, with no links of their own: in a cell dealt out in blocks, another block
    holds their other links.
    """
    (hu, hn, hx), (vu, _, vx) = homes, visitors
    window, run = (x * math.sqrt(2 - 2 * threshold) for x in (REACH, RUN_REACH))
    count = least_count()
    r = _directions(hx.shape[1])
    hx, vx = _units(hx), _units(vx)
    hp, vp = hx @ r, vx @ r
    order = np.argsort(hp[:, 0], kind="stable")
    hu, hn, hx, hp = hu[order], hn[order], hx[order], hp[order]
    order = np.argsort(vp[:, 0], kind="stable")
    vu, vx, vp = vu[order], vx[order], vp[order]
    hf, vf = hp.astype(np.float32), vp.astype(np.float32)
    wide, run = np.float32(window * (1 + 1e-5)), np.float32(run * (1 + 1e-5))
    links, linked = np.zeros(len(vu), np.int64), np.zeros(len(hu), bool)
    place = {u: k for k, u in enumerate(hu.tolist())}
    node = np.array([place.get(u, len(hu) + k) for k, u in enumerate(vu.tolist())], np.int64)
    root = np.arange(len(hu) + len(vu))
    name = np.concatenate([hu, vu])
    for a in range(0, len(vu), 256):
        b = min(a + 256, len(vu))
        first, last = np.searchsorted(hf[:, 0], [vf[a, 0] - run, vf[b - 1, 0] + run])
        if first == last:
            continue
        met = np.zeros((b - a, last - first), np.uint8)
        for k in range(DENSE):
            met += np.abs(vf[a:b, k, None] - hf[None, first:last, k]) <= wide
        likely = met >= DENSE - (DIRECTIONS - count)
        total = int(np.count_nonzero(likely))
        if total * 8 > likely.size:  # a group so close that most pairs are: the whole block at once
            good = (vx[a:b] @ hx[first:last].T >= threshold) & likely
            i, j = np.nonzero(good)
        else:
            i, j = np.nonzero(likely)
            near = met[i, j].astype(np.int64)
            for k in range(DENSE, DIRECTIONS):
                near += np.abs(vf[a + i, k] - hf[first + j, k]) <= wide
            i, j = i[near >= count], j[near >= count]
            good = np.concatenate([np.einsum("ij,ij->i", vx[a + i[s : s + 65536]], hx[first + j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
        i, j = i + a, j + first
        other = vu[i] != hu[j]
        i, j = i[other], j[other]
        links += np.bincount(i, hn[j], len(vu)).astype(np.int64)
        linked[j] = True
        starts = np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else []
        for s, e in zip(starts, [*starts[1:], len(i)], strict=False):
            mine = np.unique(root[np.append(j[s:e], node[i[s]])])
            if len(mine) > 1:
                root[np.isin(root, mine)] = mine[0]
    has = links > 0
    here = np.flatnonzero(linked)
    return {"uid": np.concatenate([vu[has], hu[here]]), "links": np.concatenate([links[has], np.zeros(len(here), np.int64)]), "other": name[root[np.concatenate([node[has], here])]]}


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.withColumn("uid", F.when(usable("vector"), F.xxhash64("vector")))
    classes = stage(rows.where("uid is not null").groupBy("uid").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")), "classes")
    visits = stage(_visits(classes.select("uid", "n", "vector"), threshold), "visits")
    # blocks of a large cell: homes in one column of blocks, visitors against every column
    sized = visits.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / CELL).alias("columns"), F.ceil(F.count(F.lit(1)) / CELL).alias("lines")).where("columns > 0")
    dealt = visits.join(sized, "cell")
    homes = dealt.where("home").withColumn("column", F.pmod(F.xxhash64("uid"), F.col("columns"))).withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1))).withColumn("side", F.lit(0))
    guests = dealt.withColumn("line", F.pmod(F.xxhash64("uid"), F.col("lines"))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("side", F.lit(1))
    names = ["cell", "line", "column", "side", "uid", "n", "vector"]
    rows_of = homes.select(*names).unionByName(guests.select(*names)).repartition(partitions(spark), "cell", "line", "column").sortWithinPartitions("cell", "line", "column", "side")

    def make():
        def table(parts: list) -> tuple:
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

        def run(batches) -> Iterator[dict]:
            at, sides = None, ([], [])
            for b in batches:
                keys = list(zip(b["cell"].to_pylist(), b["line"].to_pylist(), b["column"].to_pylist(), b["side"].to_pylist(), strict=True))
                cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
                for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    if at is not None and keys[s][:3] != at:
                        if sides[0] and sides[1]:
                            yield _in_cell(table(sides[0]), table(sides[1]), threshold)
                        sides = ([], [])
                    at = keys[s][:3]
                    sides[keys[s][3]].append((b["uid"][s:e].to_numpy(), b["n"][s:e].to_numpy(), _matrix(b["vector"][s:e])))
            if sides[0] and sides[1]:
                yield _in_cell(table(sides[0]), table(sides[1]), threshold)

        return run

    found = stage(arrow_map(rows_of, make, "uid bigint, links bigint, other bigint", 4096), "vector-links")
    roots = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    counted = classes.select("uid", "least", "n").join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left").join(roots.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = counted.join(counted.groupBy("root").agg(F.min("least").alias("component")), "root").select("uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = stage(rows.select("vec_id", "uid").join(named, "uid", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "vectors")
    unstage(classes, visits, found)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
