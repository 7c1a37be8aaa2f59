import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duochron.llm import bytebpe, packing, rans
from duochron.llm.wordcache import WordCache

TEXTS = ["", " ", "Hello world", "a  b\n\nc\td ", "it's DON'T 'll 12345 x1y2", "éÉ ñ ß Σίσυφος İstanbul é ́", "a\x1cb \x1f", " x　y z", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b", "x<|ENDOFTEXT|>y", "<|endoftext|>", "<|endoftext", "end <| of |> <|startoftext|><|endoftext|>.", "word, word. (word) \"q\" --", "ci%%% Ci%%% ci%%% İ#, İ. क़. don's... 'tis_ x_y_ É!? é!? É!?", "日本語 текст 🙂🙂", "\n", "x " * 3000, "n" * 3000]


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def cache(request):
    return WordCache(public_tokenizers.path(request.param[0]), request.param[1])


def direct(cache, texts):
    """By the library as it is loaded, not by the cache's own copy."""
    library = _fresh.setdefault(cache.path, Tokenizer.from_file(cache.path))
    return [np.array(e.ids, cache.dtype).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


_fresh: dict[str, Tokenizer] = {}


def test_words_equal_whole_texts(cache):
    for _ in range(2):
        assert cache.encode(TEXTS) == direct(cache, TEXTS)


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endOfText|>", "<|", "|>", " ", "\n", "a", "Word", "é", "\u0338", "12", ".", "\u3000"]), max_size=12))
def test_added_tokens(cache, parts):
    text = "".join(parts)
    assert cache.encode([text]) == direct(cache, [text])


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\t'.,aAéÉ1Σİ\x1ć "), st.characters(codec="utf-8")), max_size=40))
def test_any_text(cache, text):
    assert cache.encode([text]) == direct(cache, [text])


@settings(max_examples=100, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\t'aé1"), st.characters(codec="utf-8")), max_size=200))
def test_byte_bpe_round_trip(text):
    codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == codec.library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("part", ["a" * 5_000, "word and 'll more, " * 800, " " * 6_000 + "x", "\n" * 6_000, "é1" * 4_000])
def test_long_texts_are_split_safely(part, monkeypatch):
    codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bytebpe, "PART", 64)
    text = "start " + part + " end\t"
    assert codec.encode(text) == codec.library.encode_ordinary(text)


def test_very_long_white_space():
    codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "x" + " " * 1_000_000 + "y"
    assert codec.decode(codec.encode(text)) == text.encode()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int")


ROWS = [(5, "some text here", "x", 1), (1, None, "x", 2), (3, "", None, 3), (3, "other words 12", None, 3), (2, "the same", "x", 1), (2, "the same", "x", 1), (None, "no key", "x", 1), (9, "long text " * 900, "x", 1)]


def test_byte_bpe_query(spark):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digests(docs(spark, ROWS)).collect())
    codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((k or 0, len(i := codec.library.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for k, t, *_ in ROWS)
    assert got == want
    assert bytebpe.digests(docs(spark, [])).count() == 0
    back = bytebpe.decode(bytebpe.encode(docs(spark, ROWS)))
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 140_000])
def test_rans_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint16)
    table = rans.Table.quantised(np.bincount(ids, minlength=5000))
    assert n == 0 or table.freq.sum() == 1 << rans.SCALE
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    if n > 100_000:
        lanes = min(rans.LANES, n // 64)
        parts = [rans.decode_block(block, table, k) for k in range(-(-(-(-n // lanes)) // rans.CHECK))]
        assert (np.concatenate(parts) == ids).all()
        bad = bytearray(block)
        bad[-3] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(bad), table)


def test_token_files(spark):
    words = WordCache.of(public_tokenizers.path("word_bpe_49k.json"), False)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.round_trip(docs(spark, ROWS)).collect())
    at = 0
    for start, key, n, crc in got:
        assert start == at
        at += n
        texts = [t or "" for k, t, *_ in ROWS if k == key]
        assert (n, crc) in [(len(i), zlib.crc32(i.tobytes())) for t in texts for i in [np.append(np.frombuffer(words.encode([t])[0], "<u2"), 2).astype("<u4")]]
    keys = [k for _, k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == len(ROWS)
    assert rans.round_trip(docs(spark, [])).count() == 0


def test_packing(spark):
    got = packing.pack(docs(spark, ROWS)).collect()
    assert len({r.doc_id for r in got}) == len({k for k, *_ in ROWS})
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(sizes=st.lists(st.integers(1, 32), max_size=60))
def test_plan_covers_every_piece(sizes):
    counts = np.bincount(sizes, minlength=33) if sizes else np.zeros(33, np.int64)
    plan, bound = packing.solve(counts, 32, 10)
    have = np.zeros(33, np.int64)
    for config, times in plan:
        assert sum(config) <= 32
        for x in config:
            have[x] += times
    assert (have == counts).all() and sum(t for _, t in plan) >= bound - 1e-6


def test_packed_pieces_and_files_equal_the_library(spark):
    """start, length and checksums of every piece, and of every document in the files, by a freshly loaded library."""
    texts = [*TEXTS, None, "word <|endoftext|> word " * 400, "a b c " * 900]
    rows = docs(spark, [(3 * i, t, "x", 1) for i, t in enumerate(texts)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {3 * i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    got: dict = {}
    for r in packing.pack(rows).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(whole)
    for k, ids in whole.items():
        pieces = sorted(got[k], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and pieces[0].start == 0 and sum(r.length for r in pieces) == len(ids)
        assert all(r.start + r.length == s.start for r, s in zip(pieces, pieces[1:], strict=False)) and all(r.length == 1024 for r in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((3 * i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rans.round_trip(rows).orderBy("doc_id").collect()] == want
