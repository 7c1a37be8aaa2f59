"""Near-duplicate documents by MinHash with odd sketches.

A document's set is its distinct shingles of some words (with fewer words, the whole sequence as one).
MinHash values are cut into BANDS bands; documents that share a band meet. Of those that meet another,
SAMPLES MinHash samples are folded into a parity bitmap (an odd sketch): the population count of two
bitmaps' XOR estimates how many samples differ, most precisely at high similarity, and drops pairs that
can't reach the threshold before any text is compared. Links are confirmed on the full sets.

Equal sets are one node from the start. Documents that share a band are first compared with a few pivots
of it (so a group of n makes about n pairs, not n * n); after that, only documents of the same band that
are still in different components are compared with each other, which leaves no link between components
unfound. These comparisons stay inside a task: a band's group is dealt out in blocks, every two blocks
meet in a cell, sketches leave over the members that may link, and only these bring their texts to
the cell, which tests them on full sets and returns links that span what it has joined. So rows never
grow with the pairs of a group. A pair at the threshold misses every band with a probability of 3e-6, and a
sketch rejects one with less.

Defined results: documents without words have an empty set and link with nothing; null texts are
empty; equal rows are copies of each other; with equal doc_ids, texts tell rows apart; only doc_id and
text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import arrow_map, partitions, release, stage, texts, unstage
from duochron.llm.components import components

BANDS, ROWS = 32, 5
SAMPLES, BITS = 1024, 4096
#: Pivots of a band's group are the least of so many orders of its members.
ORDERS = 4
#: An estimate at a similarity of 0.8 has a standard deviation of 0.017; pairs below five of them are dropped.
MARGIN = 0.085
#: Members that one task compares with a pivot.
PER_PIVOT = 256
#: Members of a block of a band's group, and their shingles.
BLOCK, BLOCK_SHINGLES = 2_048, 1 << 22

_BAND_MULT = np.random.default_rng(20_001).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_MULT = np.random.default_rng(20_002).integers(0, 2**63, (2, SAMPLES), np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    wide = min(size, len(h))
    s = np.full(len(h) - wide + 1, np.uint64(wide))
    for k in range(wide):
        s = _mix(s * _A + h[k : len(h) - wide + 1 + k])
    return np.unique(s)


def _minhash(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    least = np.full(mult.shape[1], 2**64 - 1, np.uint64)
    step = max(1, (1 << 18) // mult.shape[1])
    for i in range(0, len(s), step):
        least = np.minimum(least, (s[i : i + step, None] * mult[0] + mult[1]).min(0))
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for part in _minhash(s, _BAND_MULT).reshape(BANDS, ROWS).T:
        key = _mix(key * _A + part)
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """BITS parities of the samples' places, in 64-bit words."""
    place = _mix(_minhash(s, _ODD_MULT) + np.arange(SAMPLES, dtype=np.uint64) * _B) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def most_bits(percent: int) -> int:
    """The population count that an XOR is expected to have at the lowest similarity that isn't dropped."""
    return int(BITS * (1 - np.exp(-2 * 2 * SAMPLES * (1 - percent / 100 + MARGIN) / BITS)) / 2)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, hash, n_shingles, node, bands``; node names the set, null if it is empty."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                n, node, bands = [], [], []
                for t in b["text"]:
                    s = shingles(t.as_py(), size)
                    n.append(len(s))
                    node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                    bands.append(band_keys(s) if len(s) else None)
                yield {"doc_id": b["doc_id"], "hash": b["hash"], "n_shingles": n, "node": node, "bands": bands}

        return run

    return arrow_map(texts(docs).withColumn("hash", F.xxhash64("text")), make, "doc_id bigint, hash bigint, n_shingles bigint, node bigint, bands array<bigint>")


def _sketches(known: DataFrame, size: int) -> DataFrame:
    """``node, n_shingles, odd`` of the documents that met another."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                found = [shingles(t.as_py(), size) for t in b["text"]]
                yield {"node": b["node"], "n_shingles": [len(s) for s in found], "odd": [odd_sketch(s) for s in found]}

        return run

    return arrow_map(known, make, "node bigint, n_shingles bigint, odd array<bigint>")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and odd sketches allow the threshold."""
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("odd").alias("oa")), "a")
    pairs = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("odd").alias("ob")), "b")
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differ <= most_bits(percent))).select("a", "b")


def _confirmed(pairs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold on their full sets. A pivot (a) travels to its members, PER_PIVOT of them at a time."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_PIVOT).alias("salts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = dealt.join(known.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    pivots = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(known.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = pivots.unionByName(members).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind")

    def make():
        def run(batches) -> Iterator[dict]:
            pivot = np.zeros(0, np.uint64)
            for b in batches:
                found_a, found_b = [], []
                for a, kind, other, text in zip(b["a"].to_pylist(), b["kind"].to_pylist(), b["b"].to_pylist(), b["text"], strict=True):
                    s = shingles(text.as_py(), size)
                    if kind == 0:
                        pivot = s
                        continue
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    if 100 * both >= percent * (len(pivot) + len(s) - both):
                        found_a.append(a)
                        found_b.append(other)
                yield {"a": found_a, "b": found_b}

        return run

    return arrow_map(rows.select("a", "kind", "b", "text"), make, "a bigint, b bigint").distinct()


def _cells(met: DataFrame) -> DataFrame:
    """``met`` (key, node, n_shingles, ...) with ``x, y``, the cell of two blocks of the key's group, and ``block``, the row's own."""
    size = met.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = met.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    names = [c for c in met.columns if c != "key"]
    return dealt.select("key", "block", other, *names).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", *names)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Cell:
    """The members of a cell, in arrays."""

    def __init__(self, x: int, y: int, band: int, parts: list[dict]):
        self.band, self.mixed = band, x != y
        self.node, self.root, self.size, self.block = (np.concatenate([p[n] for p in parts]) for n in ("node", "root", "n_shingles", "block"))
        self.odd, self.bands = (np.concatenate([p[n] for p in parts]) for n in ("odd", "bands"))
        self.odd, self.bands = self.odd.view(np.uint64), self.bands[:, :band]
        self.text = [t for p in parts for t in p.get("text", ())]

    def likely(self, percent: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the later ones that it meets in no band before, in another component, and may link with."""
        for i in range(len(self.node) - 1):
            size = self.size[i + 1 :]
            fit = (self.root[i + 1 :] != self.root[i]) & (100 * np.minimum(size, self.size[i]) >= percent * np.maximum(size, self.size[i]))
            if self.mixed:
                fit &= self.block[i + 1 :] != self.block[i]
            j = i + 1 + np.flatnonzero(fit)
            j = j[~(self.bands[j] == self.bands[i]).any(1)]
            j = j[np.bitwise_count(self.odd[j] ^ self.odd[i]).sum(1, dtype=np.int64) <= limit]
            if len(j):
                yield i, j


def _by_cell(batches) -> Iterator[tuple[tuple, _Cell]]:
    at, parts = None, []
    for b in batches:
        plain = {n: b[n].to_numpy(zero_copy_only=False) for n in ("key", "x", "y", "band", "block", "node", "root", "n_shingles")}
        wide = {n: _matrix(b[n]) for n in ("odd", "bands")} | ({"text": b["text"].to_pylist()} if "text" in b else {})
        cell = np.stack([plain[n].astype(np.int64) for n in ("key", "x", "y", "band")], 1)
        cuts = [0, *(1 + np.flatnonzero((cell[1:] != cell[:-1]).any(1))).tolist(), len(cell)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                now = tuple(cell[s].tolist())
                if at is not None and now != at:
                    yield at, _Cell(*at[1:], parts)
                    parts = []
                at = now
                parts.append({n: v[s:e] for n, v in (plain | wide).items()})
    if parts:
        yield at, _Cell(*at[1:], parts)


def _open(cells: DataFrame, percent: int) -> DataFrame:
    """``key, x, y, node`` of the members of a cell that may link with one in another component."""
    limit = most_bits(percent)

    def make():
        def run(batches) -> Iterator[dict]:
            for (key, x, y, _), cell in _by_cell(batches):
                some = np.zeros(len(cell.node), bool)
                for i, j in cell.likely(percent, limit):
                    some[i] = some[j] = True
                n = int(some.sum())
                if n:
                    yield {"key": [key] * n, "x": [x] * n, "y": [y] * n, "node": cell.node[some]}

        return run

    return arrow_map(_dealt(cells), make, "key bigint, x int, y int, node bigint")


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition(partitions(cells.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "node")


def _across(cells: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` on full sets that span what links in each cell; ``cells`` with texts."""
    limit = most_bits(percent)

    def make():
        def run(batches) -> Iterator[dict]:
            for _, cell in _by_cell(batches):
                label, found, sets = cell.root.copy(), [], [shingles(t, size) for t in cell.text]
                for i, j in cell.likely(percent, limit):
                    j = j[label[j] != label[i]]
                    if not len(j):
                        continue
                    each = np.array([len(sets[k]) for k in j])
                    joined = np.concatenate([sets[k] for k in j])
                    place = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
                    both = np.add.reduceat(sets[i][place] == joined, np.cumsum(each) - each, dtype=np.int64)
                    for k in j[100 * both >= percent * (each + len(sets[i]) - both)].tolist():
                        if label[k] != label[i]:
                            found.append((cell.node[i], cell.node[k]))
                            label[label == label[k]] = label[i]
                if found:
                    yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

        return run

    return arrow_map(_dealt(cells), make, "a bigint, b bigint")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, hash, n_shingles, component_id, first`` of every row; first marks the row of the least doc_id, then hash, of each group (nulls last), and equal rows."""
    spark = docs.sparkSession
    rows = stage(sets(docs, size), "sets")
    nodes = stage(rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("first"), F.first("bands").alias("bands")), "nodes")
    slots = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    groups = slots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.min_by("node", F.xxhash64("node", F.lit(o))).alias(f"p{o}") for o in range(ORDERS))).where("n > 1")
    met = stage(slots.join(groups, "key").select("key", "band", "node", F.element_at(F.array(*(f"p{o}" for o in range(ORDERS))), F.col("band") % ORDERS + 1).alias("pivot")), "met")

    # texts of the documents that met another one
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash"))
    source = texts(docs).withColumn("hash", F.xxhash64("text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    known = stage(source.join(wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))), ["doc_id", "hash"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    sketches = stage(_sketches(known, size), "sketches")
    release(spark)

    pairs = met.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = stage(_likely(pairs, sketches, percent), "pairs")
    links = stage(_confirmed(tried, known, size, percent), "confirmed")
    roots = components(links)
    placed = met.select("key", "band", "node").join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = placed.join(split, "key", "left_semi").join(sketches, "node").join(nodes.select("node", "bands"), "node")
    cells = stage(_cells(apart.select("key", "band", "node", "root", "n_shingles", "odd", "bands")), "cells")
    open_ = _open(cells, percent).groupBy("key", "x", "y", "node").agg(F.lit(1).alias("one")).drop("one")
    late = stage(_across(cells.join(open_, ["key", "x", "y", "node"]).join(known, "node"), size, percent), "late")
    if not late.isEmpty():
        roots = components(links.unionByName(late))
    firsts = nodes.select("node", "first").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", F.col("least").alias("first"))
    out = stage(rows.select("doc_id", "hash", "n_shingles", "node").join(named, "node", "left").select("doc_id", "hash", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), (F.col("first").isNull() | F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))).alias("first")), "near")
    unstage(rows, nodes, met, known, sketches, tried, links, cells, late)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, hash, n_shingles, component_id, kept`` of every row; hash is xxhash64 of the text."""
    return _grouped(docs, size, percent).drop("first").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, that are the first of their group; of equal rows, one."""
    marks = _grouped(docs, size, percent).where("first").select("doc_id", "hash").distinct()
    key = docs.withColumn("__duochron_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).dropDuplicates(["doc_id", "__duochron_hash"])
    marked = marks.select(F.col("doc_id").alias("__duochron_id"), F.col("hash").alias("__duochron_h"))
    return key.join(marked, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__duochron_id")) & (F.col("__duochron_hash") == F.col("__duochron_h")), "left_semi").drop("__duochron_hash")
