"""Best-fit packing of tokenised documents into sequences of at most CAPACITY ids.

The number of pieces of each length (at most CAPACITY numbers, whatever the corpus) goes to the driver,
which solves the configuration linear program over them:

    minimise sum_c x_c   such that   sum_c a[l, c] * x_c >= n[l]   for every length l,

where a configuration c is a multiset of lengths that fits one sequence. Multiplicative weights hold a
price for each length; a knapsack dynamic program finds the best-paying configurations for every length
at once; lengths that are covered too well grow cheaper. The fractional solution is rounded, what
is left is packed best-fit, largest first, and the better of that and of a plain best fit is taken.
Prices also give a lower bound on the sequences that any packing needs.

Pieces then take the places of their length by rank, which needs no shuffle of the ids themselves.

Defined results: a null or empty text is one piece, its end id; repeated rows are packed each; only
doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import public_tokenizers
from duochron.llm.common import arrow_map, stage, texts
from duochron.llm.wordcache import WordCache

CAPACITY = 1024
END = 2
ROUNDS = 120

#: A configuration: its lengths (descending) and how many sequences use it.
Plan = list[tuple[tuple[int, ...], int]]


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most that lengths with sum <= c pay; last[c]: a length in such a filling, 0 for an unused unit."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        pay = best[c - 1 :: -1][: len(price) - 1] + price[1 : c + 1]  # length 1 leaves c-1, and so on
        k = int(np.argmax(pay))
        best[c], last[c] = (pay[k], k + 1) if pay[k] > best[c - 1] else (best[c - 1], 0)
    return best, last


def _filling(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit on counts: open with the largest length left, then always the largest that still fits; whole runs of equal sequences at once."""
    left, plan = left.copy(), []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        used: Counter[int] = Counter()
        room, at = capacity, top
        while room and at:
            k = min(room // at, int(left[at]) - used[at])
            if k > 0:
                used[at] += k
                room -= k * at
            at = min(at - 1, room)
            while at and not left[at]:
                at -= 1
        times = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
        plan.append((tuple(sorted(used.elements(), reverse=True)), times))


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Plan, float]:
    """counts[l]: pieces of length l. Returns the plan and a lower bound on its sequences."""
    n = counts.astype(np.float64)
    here = np.flatnonzero(counts)
    bound = float(np.ceil((np.arange(len(counts)) * counts).sum() / capacity))
    plain = best_fit(counts, capacity)
    if len(here) == 0 or len(plain) == 1:
        return plain, bound
    size = np.arange(capacity + 1) / capacity
    covered = np.zeros(capacity + 1)
    solution: dict[tuple[int, ...], float] = defaultdict(float)
    for r in range(rounds):
        lag = np.where(counts > 0, covered / np.maximum(n, 1), 0)
        eta = 4.0
        price = np.where(counts > 0, size * np.exp(-eta * (lag - lag[here].min()) / max(1, r) ** 0.5), 0)
        best, last = _knapsack(price, capacity)
        bound = max(bound, float((price * n).sum() / best[capacity]))
        pay = price[here] + best[capacity - here]
        load = np.zeros(capacity + 1)
        found = []
        for x in here[pay >= best[capacity] * (1 - 0.02)]:
            config = tuple(sorted((int(x), *_filling(last, capacity - int(x))), reverse=True))
            found.append((config, n[x]))
            for y in config:
                load[y] += n[x]
        # the longest step that lets no length gain more than one share of the rounds
        step = float((n[load > 0] / load[load > 0]).min()) if found else 0
        for config, weight in found:
            solution[config] += step * weight
        covered += step * load
    # scaling so that more or fewer lengths are fully covered changes how much is left to best fit; take the best
    plans = [_rounded(solution, counts, scale, capacity) for q in (0, 25, 50, 75, 100) if (scale := float(np.percentile(covered[here] / n[here], q))) > 0]
    return min([*plans, plain], key=lambda p: sum(t for _, t in p)), bound


def _rounded(solution: dict[tuple[int, ...], float], counts: np.ndarray, scale: float, capacity: int) -> Plan:
    left, plan = counts.astype(np.int64).copy(), []
    for config, x in sorted(solution.items(), key=lambda kv: (-kv[1], kv[0])):
        need = Counter(config)
        times = min(int(x / scale + 0.5), *(int(left[y]) // k for y, k in need.items()))
        if times > 0:
            plan.append((config, times))
            for y, k in need.items():
                left[y] -= k * times
    return plan + best_fit(left, capacity)


def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """Runs of places: the pieces of a length with ranks from ``rank`` go to every sequence of a configuration in turn."""
    out: dict[str, list[int]] = defaultdict(list)
    have: Counter[int] = Counter()
    sequence = 0
    for config, times in plan:
        places: dict[int, list[int]] = defaultdict(list)
        at = 0
        for x in config:
            places[x].append(at)
            at += x
        for x, offsets in places.items():
            for k, v in (("length", x), ("rank", have[x]), ("each", len(offsets)), ("sequence", sequence), ("offset", offsets[0])):
                out[k].append(v)
            have[x] += len(offsets) * times
        sequence += times
    table = {k: np.array(v, np.int64) for k, v in out.items()}
    order = np.lexsort((table["rank"], table["length"])) if table else []
    return {k: v[order] for k, v in table.items()}


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with their rank among the pieces of that length in their part of the input."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        words = WordCache.of(path, spaces=True)
        part = TaskContext.get().partitionId()
        rank: Counter[int] = Counter()

        def run(batches) -> Iterator[dict]:
            for b in batches:
                rows: list[tuple] = []
                for key, data in zip(b["doc_id"].to_pylist(), words.encode(b["text"].to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(data, words.dtype), words.dtype.type(END)).astype("<u4")
                    at, piece = 0, 0
                    while at < len(ids):
                        end = at + ((len(ids) - at) % capacity or capacity)  # the first piece takes what whole pieces leave
                        rows.append((key, piece, at, end - at, zlib.crc32(ids[at:end].tobytes()), part, rank[end - at]))
                        rank[end - at] += 1
                        at, piece = end, piece + 1
                yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "local"), map(list, zip(*rows)), strict=True)) if rows else dict.fromkeys(("doc_id", "piece", "start", "length", "ids_crc32", "part", "local"), [])

        return run

    return arrow_map(texts(docs), make, _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    found = stage(pieces(docs, tokenizer, capacity), "pieces")
    by_part = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    plan, _ = solve(counts, capacity)
    table = _slots(plan)
    # rank of a part's first piece of a length: one row per part in each window, not one per piece
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def make():
        key = table["length"] * (1 << 44) + table["rank"] if table else None

        def run(batches) -> Iterator[dict]:
            for b in batches:
                length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
                i = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
                k = rank - table["rank"][i]
                yield {n: b[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": table["sequence"][i] + k // table["each"][i], "offset": table["offset"][i] + k % table["each"][i] * length}

        return run

    ranked = found.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("base")).alias("rank"))
    return arrow_map(ranked, make, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", 10_000)
