import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from duochron.llm import boosting, htmltext, lm, toxicity
from duochron.llm.queries import held_out

SF = "/root/testdata/sf0.001"


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.Trees(40, 3).fit(x[:1500], y[:1500])
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    steps = boosting.Isotonic().fit(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert steps(np.array([0.0, 1, 2, 3, 4, 9])).tolist() == [0, 0, 0.5, 0.5, 1, 1]
    assert boosting.Isotonic().fit(np.zeros(0), np.zeros(0))(np.array([1.0])).tolist() == [0.5]


def test_scores_are_probabilities_and_base_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "HOT", 80)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join(rng.choices(words[: 20 + 130 * (i % 2)], k=rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (3, "W1 new unseen"), (3, "W1 new unseen"), (None, "w1\x0bw2")]
    docs = spark.createDataFrame([(k, t, 5) for k, t in texts], "doc_id bigint, text string, score int")
    model, counts = lm.fit(docs, ~held_out(7, 2))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in lm.score(docs, model, counts).collect()))
    split = [(k, (t or "").encode().lower().split() + [None]) for k, t in texts]
    c = Counter(w for k, ws in split if k is None or zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((k if k is not None else -1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 8)) for k, ws in split)
    assert got == want
    for u, g in ((0, 0), (5, 3), (model.head, lm.CLASSES - 1)):
        p = np.exp((model.r[u] + model.s[g]) @ model.q.T + model.b - model.z[u, g])
        assert abs(p.sum() - 1) < 1e-4
    # the tokens of a kind, and one that isn't known, share the kind's probability
    own = {w for w in model.hot[: model.head]}
    for kind in range(lm.KINDS):
        of = [n for w, n in ((w or b"", n) for w, n in c.items()) if w not in own and zlib.crc32(w[-lm.ENDING :]) % lm.KINDS == kind]
        assert (model.rest[kind], model.rest_distinct[kind]) == (sum(of), len(of))
    empty = docs.limit(0)
    assert lm.score(empty, *lm.fit(empty, F.lit(True))).count() == 0


def test_kinds_are_alike_in_columns(spark):
    tokens = [b"", b"a", b"ab", b"abc", b"abcd", "naïveté".encode(), b"\xff\xfe\x00\x01"]
    rows = spark.createDataFrame([(t,) for t in tokens], "token binary").select("token", lm._kind_of("token").alias("kind")).collect()
    assert [r.kind for r in rows] == [lm._kind(bytes(r.token)) for r in rows]


def test_what_is_learnt_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 4_000)
    monkeypatch.setattr(lm, "HEAD", 300)
    monkeypatch.setattr(lm, "BATCH", 512)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (lm.fit(d, ~held_out(7, 2))[0] for d in (docs.coalesce(1), docs.repartition(7)))
    assert -(-one.total // lm.SHARD) > lm.ROUNDS
    assert all(np.array_equal(a, b) for a, b in zip(one.parameters(), many.parameters(), strict=True))


def test_language_model_beats_counts_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = lm.score(docs, *lm.fit(docs, ~held_out(7, 2))).withColumn("h", held_out(7, 2)).where("h").agg(F.sum("score"), F.sum("base_score")).first()
    assert p[0] > p[1]


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, train=~held_out(5, 0))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(held_out(5, 0)).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert right / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "you are a worthless pathetic idiot and a stupid clown", 3), (4, "x" * 50_000, 4), (4, "x" * 50_000, 4)], "doc_id bigint, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(got) == 4 and got[None] >= 0.5 > got[1] == got[2]
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and sorted(r.score for r in kept.collect()) == [1, 2, 4, 4]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_written_pages_are_told_apart():
    model = htmltext.fit()
    x, y, pages = htmltext.training_nodes(80, 4_242)
    raw, at, right, whole = model.raw(x), 0, 0, 0
    for order, marks in pages:
        got = {t.split(" ", 1)[0] for t in htmltext.decode(order, raw[at : at + len(order)])}
        at += len(order)
        there = {n.text.split(" ", 1)[0] for n in order if n.text} & marks
        right += got == there
        whole += 1
    assert right / whole > 0.9


def test_decoding_never_keeps_below_a_dropped_node():
    order = htmltext.nodes_of(htmltext.parse("<body><div><p>one</p><p>two</p></div><p>three</p></body>"))
    raw = np.full(len(order), 3.0)
    div = next(i for i, n in enumerate(order) if n.tag == "div")
    raw[div] = -20.0
    assert htmltext.decode(order, raw) == ["three"]


def test_pages(spark):
    article = "<p>First &amp; only  text\n here.</p><p>Second one, which is a longer sentence of the article. It goes on.</p>"
    page = f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Head</h1>{article}</article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u1", page, "x"), (2, None, None, "x"), (3, "u3", "", "x"), (4, "u4", "plain", "x"), (1, "u1", page, "x"), (None, "u", "<p><<>", None)], "page_id bigint, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(rows).collect()]
    want = "Head\n\nFirst & only text here.\n\nSecond one, which is a longer sentence of the article. It goes on."
    assert got.count((1, "u1", want, len(want))) == 2
    assert {(2, None, "", 0), (3, "u3", "", 0)} <= set(got) and len(got) == 6
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_real_pages_give_their_articles(spark):
    import re
    from html import unescape

    bad = 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in htmltext.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        want = [t for b in re.split(r"</?(?:p|h1)>", body) if (t := re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip())]
        bad += r.text != "\n\n".join(want)
    assert bad == 0
