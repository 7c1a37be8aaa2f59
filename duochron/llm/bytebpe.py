"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is split at safe boundaries before it reaches the library: the splitting pattern never
joins a character that isn't white space with white space after it, so the matches of both parts
together are those of the whole. Very long runs of white space, on which the library's pattern
engine overflows its stack, are encoded as the single piece that the pattern makes of them.

Defined results: a null or empty text has no ids; equal rows give equal rows; only the named key and
text columns are read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.common import WHITE_SPACE, arrow_map, texts

#: Texts of more characters are split; a run of more white space is a piece of its own.
PART = 1 << 16
RUN = 1 << 12

_BOUNDARY = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")
_LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{{RUN},}}")

_loaded: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.decimal = [b"%d" % i for i in range(max(table.values()) + 1)]

    @classmethod
    def of(cls, ranks: str, pattern: str) -> "Codec":
        if (ranks, pattern) not in _loaded:
            _loaded[ranks, pattern] = cls(ranks, pattern)
        return _loaded[ranks, pattern]

    def encode(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _LONG_RUN.finditer(text):
            ids += self._between(text, at, run.start())
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.library._encode_single_piece(text[run.start() : at])
        return ids + self._between(text, at, len(text))

    def _between(self, text: str, start: int, end: int) -> list[int]:
        ids: list[int] = []
        while end - start > PART and (cut := _BOUNDARY.search(text, start + PART, end)):
            ids += self.library.encode_ordinary(text[start : cut.start()])
            start = cut.start()
        return ids + self.library.encode_ordinary(text[start:end])

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids array<int>`` of every text."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        codec = Codec.of(path, pattern)

        def run(batches) -> Iterator[dict]:
            for b in batches:
                yield {"doc_id": b["doc_id"], "ids": [codec.encode(t) for t in b["text"].to_pylist()]}

        return run

    return arrow_map(texts(docs), make, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, decoded binary``: the raw bytes that the ids stand for (not forced into characters)."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        codec = Codec.of(path, pattern)

        def run(batches) -> Iterator[dict]:
            for b in batches:
                yield {"doc_id": b["doc_id"], "decoded": [codec.decode(x) for x in b["ids"].to_pylist()]}

        return run

    return arrow_map(encoded.select("doc_id", F.col("ids")), make, "doc_id bigint, decoded binary")


def digests(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, decode, and keep only lengths and hashes, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        codec = Codec.of(path, pattern)
        said = codec.decimal.__getitem__

        def run(batches) -> Iterator[dict]:
            for b in batches:
                n, ids_hash, bytes_hash = [], [], []
                for t in b["text"]:
                    ids = codec.encode(t.as_py())
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(b" ".join(map(said, ids))).hexdigest())
                    bytes_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": bytes_hash}

        return run

    return arrow_map(texts(docs), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
