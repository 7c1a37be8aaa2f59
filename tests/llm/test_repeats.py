import hashlib
import itertools
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from duochron.llm import repeats


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(pieces=st.lists(st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=8), deal=st.integers(1, 4))
def test_matching_statistics(pieces, deal):
    index = repeats.RunIndex(pieces)
    owners = np.arange(len(pieces)) % deal
    got, across = index.statistics(), index.statistics(owners)
    for k, p in enumerate(pieces):
        for i in range(len(p)):
            want = other = 0
            for j, q in enumerate(pieces):
                for o in range(len(q)):
                    n = 0
                    while i + n < len(p) and o + n < len(q) and p[i + n] == q[o + n]:
                        n += 1
                    want = max(want, n) if (k, i) != (j, o) else want
                    other = max(other, n) if owners[k] != owners[j] else other
            assert (got[index.start[k] + i], across[index.start[k] + i]) == (want, other)


def test_suffix_array():
    letters = np.array([5, 3, 5, 3, 5, 0, 5, 3, 5, 1])
    want = sorted(range(10), key=lambda i: list(letters[i:]))
    assert repeats.suffix_array(letters).tolist() == want


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, hash int")


def brute_passages(texts, width=repeats.SHORT, words=repeats.PASSAGE):
    data = [(t or "").encode() for t in texts]
    held = {}
    for k, d in enumerate(data):
        for i in range(len(d) - width + 1):
            held.setdefault(d[i : i + width], set()).add(k)
    out = []
    for d in data:
        kept = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if len(held[d[i : i + width]]) > 1:
                kept[i : i + width] = b"\1" * width
        runs, at = [], 0
        for on, run in itertools.groupby(kept):
            size = len(list(run))
            runs += [d[at : at + size]] if on else []
            at += size
        runs = [r for r in runs if len(r.split()) > words]
        out.append((len(runs), sum(map(len, runs))))
    return out


def check(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.digests(table(spark, texts)).collect()}
    assert [got[i][:4] for i in range(len(texts))] == brute(texts, repeats.WINDOW)
    assert [got[i][4:] for i in range(len(texts))] == brute_passages(texts)


def test_digests(spark):
    rng = random.Random(5)
    shared, other = words(rng, 120), words(rng, 160)
    near = list(other)
    near[len(near) // 2] = "#"
    texts = [None, "", "short", words(rng, 200), words(rng, 30) + shared + words(rng, 30), shared, words(rng, 10) + shared[50:] + words(rng, 90), other, other, "".join(near), "In. " * 400, "x" * 1200, "x" * 399, shared[:399], shared[:400], words(rng, 40) + other[100:520] + "é" + shared[3:]]
    check(spark, texts)
    check(spark, [])


def test_many_contexts_of_one_anchor(spark, monkeypatch):
    rng = random.Random(6)
    shared = words(rng, 70)[:330]
    texts = [words(rng, 40) + shared + words(rng, 40) for _ in range(30)]
    texts += [texts[3][100:700] + words(rng, 20), words(rng, 5) + texts[4][60:640]]
    monkeypatch.setattr(repeats, "CONTEXTS", 5)
    check(spark, texts)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(repeats, "PART", 700)
    body = words(rng, 900)
    check(spark, [body, words(rng, 50) + body[300:2900] + words(rng, 20), body[100:600]])


def test_passages_of_other_documents(spark):
    rng = random.Random(9)
    shared, own = words(rng, 55), words(rng, 80)
    texts = [words(rng, 30) + f" {shared} " + words(rng, 30), words(rng, 9) + f" {shared} " + words(rng, 40), f"{own} x {own}", shared[:190], words(rng, 20) + f" {own} {shared[:150]}", own, "of " * 300]
    check(spark, texts)
    cut = {r.doc_id: r.text for r in repeats.cut(table(spark, texts), repeats.SHORT, across=True, words=repeats.PASSAGE).collect()}
    assert all(shared[1:-1] not in t and own[1:-1] not in t for t in cut.values()) and cut[6] == texts[6] and cut[3] == texts[3]


def test_many_rows_with_one_id(spark):
    rng = random.Random(10)
    shared = words(rng, 130)
    texts = [words(rng, 20) + shared + words(rng, 20), shared[3:], shared[3:], words(rng, 20) + shared[9:]]
    rows = spark.createDataFrame([(None if i else 5, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id bigint, text string")
    got = sorted(tuple(r)[1:5] for r in repeats.digests(rows).collect())
    assert got == sorted(brute([*texts, None], repeats.WINDOW))


def test_cut_keeps_columns_and_equal_keys(spark):
    rng = random.Random(8)
    shared = words(rng, 120)
    rows = spark.createDataFrame([(1, "A " + shared, "p"), (1, "B " + shared + " C", "q"), (2, "é" * 500, "r"), (2, "é" * 500, "r"), (None, "free", None)], "doc_id bigint, text string, _hash string")
    got = sorted((r.doc_id or 0, r.text.strip(), r._hash or "") for r in repeats.cut(rows).collect())
    assert got == [(0, "free", ""), (1, "A", "p"), (1, "B C", "q"), (2, "", "r"), (2, "", "r")]
