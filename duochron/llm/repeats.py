"""Long repeats in a corpus, by run-length indexes.

Every window of so many bytes of a text has an anchor, the string of a quarter of them in it with the
least hash, so equal windows have equal anchors at equal places. Neighbouring windows with one anchor
form a context. Anchors that occur once can't be in a repeat. Where all contexts of an anchor are equal,
all their windows repeat. What is left are anchors with different contexts, whose bytes are gathered by
anchor and indexed: a suffix array's Burrows-Wheeler transform is cut into runs of equal letters, and only
the run ends are kept, each as a sample of the text position and of the match with the neighbouring
suffix over the run's border. Matching statistics (the longest match of the text from every position with
any other position) then stream from left to right: inside a run they fall by one with each letter, and
rise only at samples. Positions where they reach the window begin repeated windows. A second stream leaves
out neighbours of the position's own document, and so has the matches across documents.

An anchor with more than CONTEXTS different contexts isn't gathered in one task: its windows are
compared by their hashes in a partially aggregated count, which gives the same spans.

``digests`` looks for SHORT-byte windows first, in whole texts, and for WINDOW-byte windows only in what
these cover (a long repeat is covered by short ones). The short ones that other documents hold also give
the passages of more than PASSAGE words.

Defined results: null and empty texts have no bytes and lose none; equal rows repeat each other; matches
never cross documents, and overlapping repeats inside one count, but not as matches across documents;
with equal doc_ids, texts tell rows apart; only doc_id and text are read (``cut`` keeps all columns); an
empty table gives an empty result. Contexts and anchors are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import arrow_map, partitions, release, stage, texts, unstage

WINDOW, SHORT = 400, 200
#: Words that a shared passage has more than.
PASSAGE = 50
#: Window starts that are taken at once from a long text.
PART = 1 << 19
#: Contexts of one anchor, and bytes of one index.
CONTEXTS, INDEX = 2_000, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(10_007).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (_BASE, inverse))


_UP, _DOWN = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes: a rolling polynomial of random letters, mixed."""
    global _UP, _DOWN
    if len(data) < width:
        return np.zeros(0, np.uint64)
    if len(_UP) < len(data):
        _UP, _DOWN = _powers(max(1 << 17, 2 * len(data)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _UP[: len(data)], dtype=np.uint64)])
    h = (total[width:] - total[:-width]) * _DOWN[: len(data) - width + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def contexts(data: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(first window start, number of window starts, anchor's hash) of every context."""
    seed = max(1, window // 4)
    wide = window - seed + 1
    for at in range(0, len(data) - window + 1, PART):
        part = np.frombuffer(data, np.uint8, min(PART + window - 1, len(data) - at), at)
        h = window_hashes(part, seed)
        n = len(h) - wide + 1
        tagged = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        pad = np.full(-len(h) % wide, np.uint64(2**64 - 1))
        blocks = np.concatenate([tagged, pad]).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        size = np.diff(first, append=n)
        yield from zip((first + at).tolist(), size.tolist(), h[place[first]].view(np.int64).tolist(), strict=True)


def _anchored(source: DataFrame, window: int) -> DataFrame:
    """A row for each different context of a document: ``start`` of the first and ``more`` of the others that are equal."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                rows: dict[str, list] = {k: [] for k in ("doc_id", "hash", "anchor", "context", "size", "start", "more")}
                for key, hashed, t in zip(b["doc_id"].to_pylist(), b["hash"].to_pylist(), b["data"], strict=True):
                    data = t.as_py()
                    view = memoryview(data)
                    own: dict[tuple[int, int], list] = {}
                    for start, size, anchor in contexts(data, window):
                        name = (anchor, xxhash.xxh3_64_intdigest(view[start : start + size + window - 1]) - 2**63)
                        if name in own:
                            own[name][1].append(start)
                        else:
                            own[name] = [start, [], size]
                    rows["doc_id"] += [key] * len(own)
                    rows["hash"] += [hashed] * len(own)
                    rows["anchor"] += [a for a, _ in own]
                    rows["context"] += [c for _, c in own]
                    rows["size"] += [v[2] for v in own.values()]
                    rows["start"] += [v[0] for v in own.values()]
                    rows["more"] += [v[1] or None for v in own.values()]
                yield rows

        return run

    return arrow_map(source, make, "doc_id bigint, hash bigint, anchor bigint, context bigint, size int, start int, more array<int>")


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """By prefix doubling over the suffixes that are still tied. Letters are below 65536, and no two suffixes are equal."""
    n = len(letters)
    padded = np.concatenate([letters.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    key = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
    order = np.argsort(key)
    new = np.diff(key[order], prepend=key[order[:1]] - np.uint64(1)) != 0
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    tied = order[~(new & np.append(new[1:], True))]
    step = 4
    while len(tied):
        key = rank[tied] * (n + 2) + rank[np.minimum(tied + step, n)] + 1
        sort = np.argsort(key)
        tied, key = tied[sort], key[sort]
        old = rank[tied]
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-2) != 0, at, 0))
        new = np.diff(key, prepend=-2) != 0
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class RunIndex:
    """A collection's Burrows-Wheeler transform by its run ends, with samples of position and match."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces])
        self.text = np.frombuffer(b"\xff".join(pieces) + b"\xff" * 9, np.uint8)  # no UTF-8 text holds this byte
        n = len(self.text) - 8
        self.start = np.cumsum(sizes + 1) - sizes - 1
        ends = self.start + sizes
        letters = self.text[:n].astype(np.uint32) + np.uint32(len(pieces))
        letters[ends] = np.arange(len(pieces))  # every piece ends with a letter of its own
        self.sa = suffix_array(letters)
        self.piece = np.searchsorted(ends, np.arange(n))
        self.end = ends[self.piece]
        self.bwt = letters[self.sa - 1]

    def samples(self, owners: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and matches of run heads (with the suffix before them) and of run ends (with the one after).

        owners: the owner of each piece; suffixes of the owner itself don't count as neighbours, and what
        lies between two neighbours is the owner's, so a run goes on over it. None: all suffixes count.
        """
        if owners is None:
            border = np.flatnonzero(self.bwt[1:] != self.bwt[:-1]) + 1
            match = self._match(self.sa[border - 1], self.sa[border])
            return [(np.append(self.sa[border], self.sa[0]), np.append(match, 0)), (np.append(self.sa[border - 1], self.sa[-1]), np.append(match, 0))]
        rank = np.arange(len(self.sa))
        own = owners[self.piece[self.sa]]
        first = np.append(True, own[1:] != own[:-1])
        last = np.append(first[1:], True)
        before = np.maximum.accumulate(np.where(first, rank, 0)) - 1
        after = np.minimum.accumulate(np.where(last, rank, len(rank))[::-1])[::-1] + 1
        out = []
        for other in (before, after):
            some = (other >= 0) & (other < len(rank))
            held = np.where(some, other, 0)
            at = np.flatnonzero(~some | (self.bwt != self.bwt[held]))
            out.append((self.sa[at], np.where(some[at], self._match(self.sa[at], self.sa[held[at]]), 0)))
        return out

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, inside their pieces."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        word = np.lib.stride_tricks.as_strided(self.text, (len(self.text) - 7, 8), (1, 1))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = (word[x] == word[y])
            got = np.where(same.all(1), 8, same.argmin(1))
            out[live] += got
            live = live[(got == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def statistics(self, owners: np.ndarray | None = None) -> np.ndarray:
        """For every text position, its longest match with another one (of another owner): the samples, streamed along the text."""
        n = len(self.text) - 8
        best = np.zeros(n, np.int64)
        for places, match in self.samples(owners):
            at = np.full(n, -1, np.int64)
            at[places] = places
            value = np.zeros(n, np.int64)
            value[places] = match
            last = np.maximum.accumulate(at)
            here = np.arange(n)
            best = np.maximum(best, np.where(last >= 0, value[last] - (here - last), 0))
        return best


def repeated_starts(pieces: list[bytes], owners: np.ndarray | None, window: int) -> list[tuple[int, int, int, bool]]:
    """(piece, from, to, across) of the runs of places where a window starts that occurs anywhere else in the pieces; across: in those of another owner."""
    index = RunIndex(pieces)
    out = []
    for across in (False, True)[: 1 if owners is None else 2]:
        long = index.statistics(owners if across else None) >= window
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]  # no run goes on over a piece's end, as matches end there
        piece = index.piece[first]
        at = index.start[piece]
        out += zip(piece.tolist(), (first - at).tolist(), (last - at).tolist(), [across] * len(first), strict=True)
    return out


_RUNS = "anchor bigint, context bigint, runs array<struct<lo:int,hi:int,across:boolean>>"


def _matched(pieces: DataFrame, window: int, across: bool) -> DataFrame:
    """``pieces``: anchor, context, owner, single, data. Runs of repeated window starts of the single ones: ``anchor, context, runs``."""

    def make():
        def match(rows: list[tuple]) -> dict:
            found: dict[int, list] = {}
            for piece, lo, hi, far in repeated_starts([r[4] for r in rows], np.array([r[2] for r in rows], np.int64) if across else None, window):
                if rows[piece][3]:
                    found.setdefault(piece, []).append({"lo": lo, "hi": hi, "across": far})
            return {"anchor": [rows[p][0] for p in found], "context": [rows[p][1] for p in found], "runs": list(found.values())}

        def run(batches) -> Iterator[dict]:
            rows: list[tuple] = []
            size = 0
            for b in batches:
                for row in zip(*(b[n].to_pylist() for n in ("anchor", "context", "owner", "single", "data")), strict=True):
                    if rows and rows[-1][0] != row[0] and size >= INDEX:
                        yield match(rows)
                        rows, size = [], 0
                    rows.append(row)
                    size += len(row[4])
            if rows:
                yield match(rows)

        return run

    return arrow_map(pieces, make, _RUNS)


def _hashed(pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many contexts for one task; a run for each window start, of which a context has few."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                for anchor, context, owner, single, data in zip(*(b[n].to_pylist() for n in ("anchor", "context", "owner", "single", "data")), strict=True):
                    h = window_hashes(np.frombuffer(data, np.uint8), window).view(np.int64)
                    yield {"anchor": [anchor] * len(h), "context": [context] * len(h), "owner": [owner] * len(h), "single": [single] * len(h), "lo": np.arange(len(h)), "window": h}

        return run

    windows = arrow_map(pieces, make, "anchor bigint, context bigint, owner bigint, single boolean, lo int, window bigint")
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), (F.min("owner") != F.max("owner")).alias("across")).where("n > 1").select("anchor", "window", "across")
    met = windows.where("single").join(twice, ["anchor", "window"])
    kinds = F.collect_list(F.struct("lo", (F.col("lo") + 1).alias("hi"), "across"))
    runs = met.groupBy("anchor", "context").agg(kinds.alias("runs"))
    return runs.withColumn("runs", F.concat("runs", F.transform(F.filter("runs", lambda x: x.across), lambda x: F.struct(x.lo.alias("lo"), x.hi.alias("hi"), F.lit(False).alias("across")))))


def _source(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("data"))


def _starts(start: str, more: str):
    return F.concat(F.array(start), F.coalesce(more, F.array().cast("array<int>")))


def _found(source: DataFrame, window: int, across: bool = True) -> DataFrame:
    """``doc_id, hash, spans array<struct<s, e, across>>`` of the rows of ``source`` (doc_id, hash, data) with repeats; doc_id and hash name a row's bytes.

    All spans hold bytes of windows that occur anywhere else; the unions of those with ``across`` hold the
    bytes of windows that occur in another row (if it is asked for).
    """
    spark = source.sparkSession
    rows = stage(_anchored(source, window), "anchors")
    release(spark)
    times = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    found = rows.groupBy("anchor").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(times)).alias("n"), F.count(F.lit(1)).alias("k"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1").select("anchor", (F.col("c0") != F.col("c1")).alias("mixed"), (F.col("k") > 1).alias("wide"))
    hits = stage(rows.join(found, "anchor"), "hits")
    unstage(rows)
    release(spark)
    several = hits.where("mixed").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("more").isNotNull()).alias("within"), F.min(F.struct("doc_id", "hash", "start", "size", "more")).alias("first"))
    several = stage(several.select("anchor", "context", (F.col("k") == 1).alias("single"), "within", "first"), "contexts")

    # the bytes of one occurrence of each context, by anchor; a context of several documents is an owner of its own
    owner = F.when(F.col("single"), F.xxhash64("first.doc_id", "first.hash")).otherwise(F.col("context"))
    wanted = several.groupBy(F.coalesce("first.doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("first.hash").alias("hash")).agg(F.collect_list(F.struct("anchor", "context", owner.alias("owner"), "single", "first.start", "first.size")).alias("asked"))

    def fetch():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                for t, asked in zip(b["data"], b["asked"].to_pylist(), strict=True):
                    data = t.as_py()
                    yield {k: [x[k] for x in asked] for k in ("anchor", "context", "owner", "single")} | {"data": [data[x["start"] : x["start"] + x["size"] + window - 1] for x in asked]}

        return run

    keyed = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    pieces = stage(arrow_map(keyed.join(wanted, ["doc_id", "hash"]).select("data", "asked"), fetch, "anchor bigint, context bigint, owner bigint, single boolean, data binary"), "pieces")
    release(spark)
    many = several.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    pieces_of = pieces.join(many, "anchor")
    few = pieces_of.where(F.col("contexts") <= CONTEXTS).drop("contexts").dropDuplicates(["anchor", "context"])
    few = few.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "context")
    lots = pieces_of.where(F.col("contexts") > CONTEXTS).drop("contexts").dropDuplicates(["anchor", "context"])
    partly = stage(_matched(few, window, across).unionByName(_hashed(lots, window)), "partly")

    known = several.where("not single or within").select("anchor", "context", (~F.col("single")).alias("shared"))
    whole = hits.join(known, ["anchor", "context"], "left").where("not mixed or shared is not null").withColumn("across", F.coalesce("shared", "wide"))
    def moved(at, lo, hi, far):
        return F.struct((at + lo).alias("s"), (at + hi + F.lit(window - 1)).alias("e"), far.alias("across"))

    marks = whole.select("doc_id", "hash", F.transform(_starts("start", "more"), lambda at: moved(at, F.lit(0), F.col("size"), F.col("across"))).alias("spans"))
    some = several.where("single").join(partly, ["anchor", "context"])
    some = some.select(F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash"), F.flatten(F.transform(_starts("first.start", "first.more"), lambda at: F.transform("runs", lambda x: moved(at, x.lo, x.hi, x.across)))).alias("spans"))
    out = stage(marks.unionByName(some).groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    unstage(hits, several, pieces, partly)
    release(spark)
    return out


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, hash, spans array<struct<s, e, across>>`` of the documents with repeats; spans of bytes, not merged. hash is xxhash64 of the text."""
    return _found(_source(docs), window)


def _each(column: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """The starts, ends and marks of every row's spans; of a null, none."""
    fields = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()]
    edge = column.offsets.to_numpy()
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield tuple(f[a:b] for f in fields)


def merged(spans: tuple[np.ndarray, ...], across: bool = False) -> list[tuple[int, int]]:
    """The unions of the spans, or of those across documents."""
    s, e, far = spans
    if across and len(s):
        s, e = s[far.astype(bool)], e[far.astype(bool)]
    if not len(s):
        return []
    order = np.argsort(s)
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return list(zip(s[new].tolist(), e[np.append(new[1:], len(e)) - 1].tolist(), strict=True))


def passages(data: bytes, spans: tuple[np.ndarray, ...], words: int = PASSAGE) -> list[tuple[int, int]]:
    """The stretches of more than so many words that other documents hold."""
    return [(s, e) for s, e in merged(spans, True) if len(data[s:e].split()) > words]


def without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in gone:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


_SPANS = "__duochron_spans"


def _with_spans(docs: DataFrame, found: DataFrame, name: str = _SPANS) -> DataFrame:
    """Adds the spans of each row's text; the columns of ``docs`` may have any names but those that start with __duochron_."""
    marked = found.select(F.col("doc_id").alias("__duochron_id"), F.col("hash").alias("__duochron_h"), F.col("spans").alias(name))
    hashed = docs.withColumn("__duochron_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return hashed.join(marked, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__duochron_id")) & (F.col("__duochron_hash") == F.col("__duochron_h")), "left").drop("__duochron_hash", "__duochron_id", "__duochron_h")


def _covered(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``doc_id, hash, part, at, data``: the stretches of at least ``window`` bytes that the spans cover; ``part`` names one's bytes, ``at`` is where it begins."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                rows = []
                for key, hashed, t, spans in zip(b["doc_id"].to_pylist(), b["hash"].to_pylist(), b["data"], _each(b["spans"]), strict=True):
                    data = t.as_py()
                    for s, e in merged(spans):
                        if e - s >= window:
                            rows.append((key, hashed, xxhash.xxh3_64_intdigest(b"%d %d" % (hashed, s)) - 2**63, s, data[s:e]))
                yield {k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "hash", "part", "at", "data"))}

        return run

    keyed = F.coalesce("doc_id", F.lit(-(2**63)))
    met = _source(docs).withColumn("doc_id", keyed).join(found.withColumn("doc_id", keyed), ["doc_id", "hash"])
    return arrow_map(met, make, "doc_id bigint, hash bigint, part bigint, at int, data binary").withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes`` of every row.

    Removed are the bytes of WINDOW-byte strings that also start elsewhere. The passages, which are only
    counted, are stretches of more than PASSAGE words, made of SHORT-byte strings that other documents hold.
    """
    short = spans(docs, SHORT)
    covered = stage(_covered(docs, short, WINDOW), "covered")
    long = _found(covered.select("doc_id", F.col("part").alias("hash"), "data"), WINDOW, across=False)
    places = covered.select("doc_id", "hash", "part", "at").distinct()
    named = long.select(F.col("doc_id").alias("id"), F.col("hash").alias("name"), "spans")
    moved = named.join(places, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("name") == F.col("part")))
    moved = moved.select("doc_id", "hash", F.transform("spans", lambda x: F.struct((x.s + F.col("at")).alias("s"), (x.e + F.col("at")).alias("e"), x.across.alias("across"))).alias("spans"))
    moved = moved.groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                rows = []
                for t, found, near in zip(b["text"], _each(b[_SPANS]), _each(b["__duochron_short"]), strict=True):
                    data = t.as_py().encode()
                    gone, shared = merged(found), passages(data, near)
                    rows.append((len(data), sum(e - s for s, e in gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest(), len(shared), sum(e - s for s, e in shared)))
                yield {"doc_id": b["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"))}

        return run

    return arrow_map(_with_spans(_with_spans(texts(docs), moved), short, "__duochron_short"), make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_bytes bigint")


def cut(docs: DataFrame, window: int = WINDOW, across: bool = False, words: int = 0) -> DataFrame:
    """The rows of ``docs``, all their columns, with the repeated bytes gone from their texts (broken characters at the cuts are dropped).

    across: only what other documents hold. words: only stretches of more words than that.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        def shorter(text: str | None, found: tuple[np.ndarray, ...]) -> str | None:
            if not len(found[0]):
                return text
            data = text.encode()
            return without(data, [(s, e) for s, e in merged(found, across) if not words or len(data[s:e].split()) > words]).decode(errors="ignore")

        def run(batches) -> Iterator[dict]:
            for b in batches:
                said = [shorter(t, found) for t, found in zip(b["text"].to_pylist(), _each(b.pop(_SPANS)), strict=True)]
                yield b | {"text": said}

        return run

    return arrow_map(_with_spans(docs, spans(docs, window)), make, fields)
