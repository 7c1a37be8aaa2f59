import random

import numpy as np
import pytest

from duochron.llm import covertree, oddsketch, vectors
from duochron.llm.components import components


def closure(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    links = [(1, 2), (3, 2), (10, 11), (12, 11), (12, 13), (20, 20), (5, 1)] + [(100 + i, 101 + i) for i in range(12)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = closure({x for link in links for x in link}, links)
    assert got == {k: v for k, v in want.items() if k != 20}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_sets(texts, size):
    out = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def check_near(spark, texts, size):
    rows = spark.createDataFrame([(k, t, "x", True) for k, t in texts], "doc_id bigint, text string, component_id string, kept boolean")
    got = {r.doc_id: r for r in oddsketch.near_duplicates(rows, size).collect()}
    s = shingle_sets(texts, size)
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = closure(list(s), links)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(s[k]) and r.kept == (want[k] == k) for k, r in got.items())
    return links


def mutated(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(size)
    texts = [(90, None), (91, ""), (92, " \t\n"), (93, "One"), (94, "one"), (95, "two words"), (96, "x " * 4000)]
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        texts += [(100 + 20 * g + i, mutated(rng, base, rng.choice([0, 1, 2, 4, len(base) // 20, len(base) // 12]))) for i in range(12)]
    texts += [(400 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(80))) for i in range(20)]
    assert check_near(spark, texts, size)


def test_groups_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(oddsketch, "BLOCK", 5)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [(i, mutated(rng, base, rng.choice([1, 6, 8, 9, 10, 12]))) for i in range(70)]  # many pairs on either side of the threshold
    links = check_near(spark, texts, 2)
    assert 100 < len(links) < 70 * 69 / 2 - 300


def test_null_ids_in_a_linked_class(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(7, words), (None, words), (10, words + " x"), (None, words + " y")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in oddsketch.near_duplicates(rows).collect())
    assert got == [(0, 7, False), (0, 7, False), (7, 7, True), (10, 7, False)]


def test_chains_link_through_the_middle(spark):
    base = [f"w{i}" for i in range(120)]
    chain, now = [], list(base)
    for k in range(8):
        chain.append((k + 1, " ".join(now)))
        now[k * 6 : k * 6 + 6] = [f"n{k}x{i}" for i in range(6)]
    check_near(spark, chain, 2)


def test_near_duplicates_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert oddsketch.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (3, "A b c d e f", 3), (None, "q r s t u v", 4), (7, "something else here now and then", 5)], "doc_id bigint, text string, hash int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in oddsketch.near_duplicates(rows).collect())
    assert got == [(-1, 2, -1, True), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (7, 2, 7, True)]
    assert sorted(r.hash for r in oddsketch.one_of_each(rows).collect()) == [3, 4, 5]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        x = int(np.bitwise_count(oddsketch.odd_sketch(a).view(np.uint64) ^ oddsketch.odd_sketch(b).view(np.uint64)).sum())
        guess = 1 + oddsketch.BITS / (4 * oddsketch.SAMPLES) * np.log(1 - 2 * x / oddsketch.BITS)
        assert abs(guess - share) < 0.07


def vector_rows(seed, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((120, dims))
    for g in range(8):
        x[g * 10 : g * 10 + 10] = x[g * 10] + rng.standard_normal((10, dims)) * rng.choice([0.02, 0.1, 0.16])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, [0.0] * dims), (203, None), (204, [float("nan")] + [1.0] * (dims - 1)), (205, [None] + [1.0] * (dims - 1)), (206, []), (207, [2.0 * v for v in rows[7][1]]), (208, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("cell", [8192, 16])
def test_vector_links(spark, cell, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", cell)
    rows = vector_rows(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    good = {k: np.array(v, float) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95]
    found = sum(r.n_links for r in got.values())
    assert found <= len(links) and found >= 0.99 * len(links) > 100
    want = closure([k for k, _ in rows], links)
    assert {k: r.component_id for k, r in got.items()} == want and all(r.kept == (k == want[k]) for k, r in got.items())
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_pairs_outside_the_first_window_only():
    """A link that one window of 20 doesn't hold is counted, also if that is the window of the sorted projection."""
    rng, dims = np.random.default_rng(12), 64
    r = vectors._directions(dims)
    span = np.sqrt(2 - 2 * 0.95)
    found = tried = 0
    while tried < 20:
        step = np.linalg.lstsq(r.T, np.append(1.1 * vectors.REACH, rng.uniform(-2, 2, vectors.DIRECTIONS - 1)) * span, rcond=None)[0]
        a = rng.standard_normal(dims)
        a -= a @ step / (step @ step) * step
        a *= np.sqrt(1 - step @ step / 4) / np.linalg.norm(a)
        v, h = (a + step / 2)[None], (a - step / 2)[None]
        if (v @ h.T).item() < 0.95:
            continue
        tried += 1
        one = np.ones(1, np.int64)
        found += int(vectors._in_cell((one, one, h), (2 * one, one, v), 0.95)["links"].sum())
    assert found == tried


@pytest.mark.parametrize("cell", [8192, 16, 3])
def test_vector_chains_and_pairs_in_blocks(spark, cell, monkeypatch):
    """Vectors that link only with the one before and after: each link is the only one between two parts of its component."""
    monkeypatch.setattr(vectors, "CELL", cell)
    rng, rows = np.random.default_rng(11), []
    for g in range(40):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        rows += [(100 * g + k, (np.cos(k * np.pi / 12) * a + np.sin(k * np.pi / 12) * b).tolist()) for k in range(2 + g % 7)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    links = [(p, q) for p, v in rows for q, w in rows if p != q and np.dot(v, w) >= 0.95]
    assert sum(r.n_links for r in got.values()) == len(links)
    want = closure([k for k, _ in rows], links)
    assert {k: r.component_id for k, r in got.items()} == want and all(r.kept == (k == want[k]) for k, r in got.items())


@pytest.mark.parametrize(("shard", "leaf"), [(16_384, 64), (40, 4)])
def test_top_k(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr(covertree, "SHARD", shard)
    monkeypatch.setattr(covertree, "QUERIES", shard)
    rows = vector_rows(4) + [(7, vector_rows(4)[7][1]), (40, vector_rows(4)[41][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in covertree.top_k(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(k, np.floor(64 * np.array(v, float))) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for query in {k for k, _ in good if k % 20 == 0}:
        want = []
        for own, (k, q) in enumerate(good):
            if k == query:
                s = sorted((-int(q @ c), j) for n, (j, c) in enumerate(good) if n != own and len(c) == len(q))[:20]
                want += [(i + 1, j, -x) for i, (x, j) in enumerate(s)]
        assert sorted(got[query]) == sorted(want)
    assert covertree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(9)
    c = np.floor(64 * (rng.standard_normal((600, 3)) * 0.05 + rng.standard_normal((6, 3)).repeat(100, 0) * 3))
    q = c[::7]
    ids = rng.permutation(600)
    who, best = covertree.search(q, c, ids, 10)
    for i in range(len(q)):
        s = c @ q[i]
        want = np.lexsort((ids, -s))[:10]
        assert who[i].tolist() == want.tolist() and best[i].tolist() == s[want].tolist()


def test_top_k_without_an_id(spark):
    rows = [(None, [1.0, 1.0]), (20, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 1.0]), (None, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in covertree.top_k(v, v.where("vec_id % 20 = 0 or vec_id is null")).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 64 * 64 + 32 * 64), (20, 2, 1, 64 * 32 + 32 * 32)]
