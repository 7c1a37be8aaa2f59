import corpus_pipeline
from duochron.llm import queries
from duochron.llm.queries import held_out
from tests.llm.test_neighbours import closure, shingle_sets
from tests.llm.test_repeats import brute_passages

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_equal_their_brute_force(spark):
    from duochron.llm import toxicity
    from duochron.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    clean = stage(steps["toxicity"](spark, docs, SF), "t")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), train=~held_out(5, 0))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}

    single = stage(steps["minhash near-dedup"](spark, clean, SF), "n")
    s = shingle_sets([(r.doc_id, r.text) for r in clean.collect()], 5)
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    assert {r.doc_id for r in single.collect()} == {k for k, v in closure(list(s), links).items() if k == v}

    cut = stage(steps["suffix-array dedup"](spark, single, SF), "c")
    before = {r.doc_id: r.text for r in single.collect()}
    removed = {k: b[1] for k, b in zip(before, brute_passages(before.values()), strict=True)}
    after = {r.doc_id: r for r in cut.collect()}
    assert clean.columns == single.columns == cut.columns == columns and set(after) == set(before)
    for k, r in after.items():
        assert len((before[k] or "").encode()) - removed[k] - len(r.text.encode()) in range(4) and r.n_chars == len(r.text)

    packed = steps["best-fit packing"](spark, cut, SF).collect()
    assert {r.doc_id for r in packed} == set(after) and all(r.offset + r.length <= 1024 for r in packed)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_document_of_each_group_with_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    copy = lambda k, tail: " ".join([f"g{k}", *words[k:], tail])
    rows = [(7, copy(0, "a")), (7, copy(0, "b")), (7, copy(0, "b")), (None, copy(0, "c")), (9, copy(0, "d"))]  # one group: a repeated id, a null one and a larger one
    rows += [(None, " ".join(f"n{i}" for i in range(60)) + t) for t in (" x", " y", " z")]  # one group, all without an id
    rows += [(None, "one two three four five six"), (None, "ONE two three four five six"), (5, "one two three four five six")]  # one set of words
    rows += [(7, "alone here with an id seen before"), (None, "alone without"), (None, None), (8, "")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()]
    group = lambda text: (text or "").split(" ")[0].lower()
    assert sorted(group(t) for _, t in kept) == ["", "", "alone", "alone", "g0", "n0", "one"]
    assert {(i, group(t)) for i, t in kept} == {(7, "g0"), (None, "n0"), (5, "one"), (7, "alone"), (None, "alone"), (None, ""), (8, "")}
