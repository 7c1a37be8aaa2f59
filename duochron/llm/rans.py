"""Token-id files: a static range asymmetric numeral system with shared frequency tables.

A file set below one folder is

* ``tables``: token, freq: one frequency table of the whole corpus, quantised to 2**SCALE, shared by
  all blocks (at most one row per vocabulary entry, whatever the corpus);
* ``blocks``: one row per independent block: its part and number, the id that its first token has in
  the whole sequence, the doc_ids and lengths of the whole documents in it, and the encoded ids.

A block interleaves up to LANES coder states over one stream of 32-bit words. Checkpoints hold the
states and the stream position every CHECK steps, so that even the parts of one block can be decoded in
parallel; checksums cover the ids and the encoded bytes. Documents are in ascending doc_id order over
parts, blocks and places. Spark's committer writes the folder, so a retried task leaves no double block.

Defined results: a null or empty text is its end id alone; equal rows are kept as often as they occur;
null doc_ids come first; clashing extra columns are not read; an empty table gives empty files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from duochron.llm.common import arrow_map, partitions, release, shared_dir, stage, texts, unstage
from duochron.llm.wordcache import WordCache

SCALE = 20
LANES, BLOCK, CHECK = 2048, 1 << 18, 64
END = 2
_LOW = 1 << 31
_HEAD = struct.Struct("<4sIHHIIII")
_BLOCKS = "part int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"


class Table:
    """Frequencies that sum to 2**SCALE; every token that occurs has at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def quantised(cls, counts: np.ndarray) -> "Table":
        total, whole = int(counts.sum()), 1 << SCALE
        if (counts > 0).sum() > whole:
            raise ValueError("more tokens occur than the table has room for")
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * whole // max(total, 1)), 0).astype(np.int64)
        over = int(freq.sum()) - whole
        order = np.argsort(-freq, kind="stable")
        while total and over:
            if over < 0:
                freq[order[0]] -= over
                over = 0
            else:  # take from the largest, keeping at least 1
                take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // whole))
                take = np.where(freq[order] > 1, take, 0)
                take = np.where(np.cumsum(take) <= over, take, 0)
                freq[order] -= take
                over -= int(take.sum())
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    most = freq << np.uint64(63 - SCALE)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    sent = 0
    for t in range(steps - 1, -1, -1):
        a = t * lanes
        b = min(a + lanes, n)
        y, f = x[: b - a], freq[a:b]
        big = y >= most[a:b]
        if big.any():
            out = (y[big] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            sent += len(out)
            y = np.where(big, y >> np.uint64(32), y)
        q = y // f
        x[: b - a] = (q << np.uint64(SCALE)) + (y - q * f) + start[a:b]
        if t % CHECK == 0:
            marks.append((sent, x.copy()))
    marks.reverse()
    body = b"".join([*(struct.pack("<I", sent - at) + s.astype("<u8").tobytes() for at, s in marks), *(w.tobytes() for w in reversed(words))])
    return _HEAD.pack(b"RNS1", n, lanes, CHECK, len(marks), sent, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: bytes, table: Table, only: int | None = None) -> np.ndarray:
    """The block's ids, or those from checkpoint ``only`` to the next."""
    magic, n, lanes, check, n_marks, n_words, ids_crc, body_crc = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != b"RNS1" or zlib.crc32(body) != body_crc:
        raise ValueError("the block is damaged")
    wide = 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, n_marks * wide).astype(np.uint64)
    first = 0 if only is None else only
    at = struct.unpack_from("<I", body, first * wide)[0] if n_marks else 0
    x = np.frombuffer(body, "<u8", lanes, first * wide + 4).astype(np.uint64) if n_marks else np.zeros(0, np.uint64)
    steps = -(-n // lanes)
    last = steps if only is None else min(steps, (only + 1) * check)
    out = np.empty(min(n, last * lanes) - first * check * lanes if n else 0, np.uint32)
    low, shift, mask = np.uint64(_LOW), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for t in range(first * check, last):
        a = t * lanes
        b = min(a + lanes, n)
        y = x[: b - a]
        slot = y & mask
        s = table.token[slot]
        out[a - first * check * lanes : b - first * check * lanes] = s
        y = table.freq[s] * (y >> shift) + slot - table.start[s]
        need = y < low
        k = int(np.count_nonzero(need))
        if k:
            y[need] = (y[need] << np.uint64(32)) | words[at : at + k]
            at += k
        x[: b - a] = y
    if only is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the block's ids are damaged")
    return out


def _chunks(docs: DataFrame, path: str) -> DataFrame:
    """Whole documents in doc_id order, tokenised, in rows of about BLOCK ids."""

    def make():
        words = WordCache.of(path, spaces=False)
        part = TaskContext.get().partitionId()
        end = np.array([END], words.dtype).tobytes()
        width = words.dtype.itemsize

        def run(batches) -> Iterator[dict]:
            block, start, have = 0, 0, 0
            keys: list[pa.Array] = []
            lengths: list[int] = []
            data: list[bytes] = []

            def full() -> dict:
                return {"part": [part], "block": [block], "start": [start], "n_tokens": [have], "doc_ids": [[k for a in keys for k in a]], "lengths": [lengths], "data": [b"".join(data)]}

            for b in batches:
                ids = words.encode(b["text"].to_pylist())
                for key, x in zip(b["doc_id"].to_pylist(), ids, strict=True):
                    n = len(x) // width + 1
                    keys.append([key])
                    lengths.append(n)
                    data += (x, end)
                    have += n
                    if have >= BLOCK:
                        yield full()
                        block, start, have = block + 1, start + have, 0
                        keys, lengths, data = [], [], []
            if lengths:
                yield full()

        return run

    spark = docs.sparkSession
    rows = texts(docs).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return arrow_map(rows.select("doc_id", "text"), make, _BLOCKS)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> str:
    """Encode every text, append the end id, and write the files; returns ``folder``."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    words = WordCache.of(path, spaces=False)
    dtype, size = words.dtype, words.size
    chunks = stage(_chunks(docs, path), "chunks")
    release(spark)

    def count():
        def run(batches) -> Iterator[dict]:
            total = np.zeros(size, np.int64)
            for b in batches:
                for x in b["data"]:
                    total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size)
            seen = np.flatnonzero(total)
            yield {"token": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])}

        return run

    counts = np.zeros(size, np.int64)
    for token, n in arrow_map(chunks.select("data"), count, "token int, n bigint", 8).groupBy("token").agg(F.sum("n")).collect():  # at most one row per vocabulary entry
        counts[token] = n
    table = Table.quantised(counts)
    spark.createDataFrame(pa.table({"token": pa.array(np.arange(size, dtype=np.int32)), "freq": pa.array(table.freq.astype(np.int64))})).coalesce(1).write.parquet(f"{folder}/tables")

    # one row per part; a part's start is the number of ids before it
    totals = dict(chunks.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    freq = table.freq

    def pack():
        shared = Table(freq)

        def run(batches) -> Iterator[dict]:
            for b in batches:
                starts = [s + base[p] for s, p in zip(b["start"].to_pylist(), b["part"].to_pylist(), strict=True)]
                yield b | {"start": starts, "data": [encode_block(np.frombuffer(x.as_buffer(), dtype), shared) for x in b["data"]]}

        return run

    arrow_map(chunks, pack, _BLOCKS, 8).write.option("compression", "none").parquet(f"{folder}/blocks")
    unstage(chunks)
    return folder


def _read(spark: SparkSession, folder: str, emit, schema: str) -> DataFrame:
    freq = np.array([r[0] for r in spark.read.parquet(f"{folder}/tables").orderBy("token").select("freq").collect()], np.int64)

    def make():
        shared = Table(freq)

        def run(batches) -> Iterator[dict]:
            for b in batches:
                for start, keys, lengths, data in zip(b["start"].to_pylist(), b["doc_ids"], b["lengths"], b["data"], strict=True):
                    ids = decode_block(data.as_buffer().to_pybytes(), shared)
                    n = lengths.values.to_numpy()
                    yield {"doc_id": keys.values} | emit(start + np.cumsum(n) - n, n, np.split(ids.astype("<u4"), np.cumsum(n)[:-1]))

        return run

    return arrow_map(spark.read.parquet(f"{folder}/blocks"), make, schema, 8)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files."""
    return _read(spark, folder, lambda start, n, ids: {"start": start, "ids": [x.tolist() for x in ids]}, "doc_id bigint, start bigint, ids array<bigint>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    return _read(spark, folder, lambda start, n, ids: {"start": start, "n_tokens": n, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read their digests back."""
    spark = docs.sparkSession
    return read_digests(spark, write(docs, f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}", tokenizer))
