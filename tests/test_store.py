import pytest
from pyspark.sql import functions as F

from duochron.client import Client
from duochron.operators import ingest, reads
from duochron.plans.config import Config
from duochron.plans.registry import AlreadyExists, Feature, Group, NotFound, Registry
from duochron.plans.store import Locked, ReadOnly, Store
from duochron.schema import EVENT_INPUT, VALUE_FIELDS
from duochron.sources import files
from duochron.streaming import ingest as streaming
from tests import model


def price(**more):
    return Feature("prod", "f_price", "price", "instrument", "double", **more)


def row(batch, write_id, value, e, s=None, arrival=0, position=0, op="UPSERT", feature="f_price"):
    held = {"value_type": "double"} | {f: None for f in VALUE_FIELDS.values()} | {"double_value": value}
    return {"batch_id": batch, "arrival": arrival, "position": position, "tenant_id": "prod", "entity_type": "instrument", "entity_id": "AAPL", "feature_id": feature, "event_time_us": e, "system_time_us": s, "operation": op, "value": held, "write_id": write_id, "source_id": "t"}


def write(store, *rows, **more):
    return {r.batch_id: (r.status, r.accepted_events, r.error) for r in store.write(store.spark.createDataFrame(rows, EVENT_INPUT), **more).collect()}


def value_at(store, e=10_000, s=10**18):
    r = reads.as_of(store.events(), e, s).first()
    return r and r.found and r.value.double_value


def test_batches_are_atomic_and_idempotent(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.register(price())
        assert write(s, row("b1", "w1", 10.0, 100)) == {"b1": ("ACCEPTED", 1, None)}
        assert write(s, row("b2", "w1", 20.0, 200), row("b2", "w2", 30.0, 300, position=1)) == {"b2": ("DEDUPED", 0, None)}
        assert write(s, row("b3", "dup", 1.0, 1), row("b3", "dup", 2.0, 2, position=1))["b3"] == ("REJECTED", 0, "DUPLICATE_WRITE_ID")
        assert write(s, row("b4", "w4", 1.0, 0))["b4"][2] == "INVALID_EVENT_TIME"
        assert write(s, row("b5", "w5", 1.0, 5, feature="f_no"))["b5"][2] == "FEATURE_NOT_FOUND"
        assert write(s, row("b6", "w6", 1.0, 5, s=7))["b6"][2] == "SYSTEM_TIME_NOT_TRUSTED"
        assert value_at(s) == 10.0
        got = write(s, row("A", "1", 1.0, 900, arrival=1), row("B", "1", 2.0, 901, arrival=2), row("B", "2", 2.0, 902, arrival=2, position=1), row("C", "2", 3.0, 903, arrival=3))
        assert {k: v[0] for k, v in got.items()} == {"A": "ACCEPTED", "B": "DEDUPED", "C": "ACCEPTED"}
        lsns = [r.lsn for r in s.events().orderBy("sequence_no").collect()]
        assert lsns == [1, 2, 3]


def test_admission_equals_a_sequential_writer(spark, tmp_path):
    import random

    rng = random.Random(3)
    batches = [(f"b{i:02d}", [str(x) for x in rng.sample(range(25), 2)]) for i in range(20)]
    df = spark.createDataFrame([(b, i, w) for i, (b, ids) in enumerate(batches) for w in ids], "batch_id string, arrival int, write_id string")
    n = iter(range(1000))

    def staged(x):
        path = str(tmp_path / str(next(n)))
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    got = sorted(r[0] for r in ingest.admitted(df, spark.createDataFrame([("3",)], "write_id string"), staged).collect())
    assert got == model.admitted(batches, {"3"})


def test_checkpoint_compaction_and_sources_change_no_answer(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.register(price())
        for i in range(3):
            write(s, row(f"b{i}", f"w{i}", 10.0 + i, 100 + i, 100 + i), trusted=True)
        before = sorted(map(str, reads.latest(s.events()).collect()))
        assert s.events("memory").count() == 3 and s.health()["segments"] == 3
        assert s.checkpoint()["lsn"] == 3
        assert s.events("memory").count() == 0
        write(s, row("d", "w9", None, 103, 103, op="DELETE"), trusted=True)
        s.compact()
        assert s.events().count() == 4 and not reads.latest(s.events()).first().found
        assert s.health() == {"status": "HEALTHY", "lsn": 4, "version": s.state["version"], "segments": 1, "compactions_queued": 0}
        s.compact("last_k", 1)
        assert [r.operation for r in s.events().collect()] == ["DELETE"]
        assert before and s.stats().first().rows == 1
    with Store(spark, str(tmp_path / "s")) as s:
        assert s.state["lsn"] == 4 and s.registry.get("prod", "f_price") and s.events().count() == 1


def test_folders_prune_and_history_is_not_shuffled(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.register(price(), Feature("prod", "f_size", "size", "instrument", "double"))
        write(s, row("b1", "w1", 1.0, 100), row("b2", "w2", 2.0, 100, arrival=1, feature="f_size"))
        s.checkpoint()
        write(s, row("b3", "w3", 3.0, 200))
        s.checkpoint()
        assert len(s.state["parts"]) == 2 and s.events().count() == 3  # the second checkpoint left the first part alone
        one = s.events("disk", "prod", "f_price")
        assert sorted(r.write_id for r in one.collect()) == ["w1", "w3"]
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_t" in plan and "f_price" in plan
        ids = s._scratch(spark.createDataFrame([("b9", "w1"), ("b9", "w9")], "batch_id string, write_id string"))
        found = ingest.seen_ids(ids, s.events())
        assert [r[0] for r in found.collect()] == ["w1"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 2
        s.compact()
        assert len(s.state["parts"]) == 1 and s.events().count() == 3


def test_layout_splits_a_hot_entity_by_time(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), rows_per_file=50) as s:
        s.register(price())
        rows = [row(f"b{i}", f"w{i}", 1.0, 100 + i, arrival=i) for i in range(400)]
        assert s.write(spark.createDataFrame(rows, EVENT_INPUT)).where("status = 'ACCEPTED'").count() == 400
        s.checkpoint()
        sizes = [r.n for r in s.events().groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) >= 5 and sum(sizes) == 400 and max(sizes) <= 150


def test_lock_read_only_and_closed(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root) as s:
        s.register(price())
        with pytest.raises(Locked):
            Store(spark, root).__enter__()
        s.read_only = True
        assert s.health()["status"] == "READ_ONLY"
        with pytest.raises(ReadOnly):
            write(s, row("b", "w", 1.0, 1))
    with pytest.raises(RuntimeError):
        s.events()


def test_backup_and_restore(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.register(price())
        write(s, row("b1", "w1", 10.0, 100))
        with pytest.raises(ValueError):
            s.backup(str(tmp_path / "s" / "inside"))
        s.backup(str(tmp_path / "copy"))
        write(s, row("b2", "w2", 20.0, 200))
        assert value_at(s) == 20.0
        with pytest.raises(Exception):
            s.restore(str(tmp_path / "nothing"))
        assert value_at(s) == 20.0
        s.restore(str(tmp_path / "copy"))
        assert value_at(s) == 10.0
        write(s, row("b3", "w3", 30.0, 300))
        assert value_at(s) == 30.0


def test_client(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        c = Client(s)
        for f, kind in (("f_bool", "bool"), ("f_int", "int64"), ("f_str", "string"), ("f_vec", "float_vector"), ("f_none", "double")):
            c.register("prod", f, kind)
        e = c.entity("prod", "AAPL")
        values = {"f_bool": False, "f_int": 9223372036854775000, "f_str": 'quote " and\nline', "f_vec": [1.25, -2.5, 3.75]}
        for f, v in values.items():
            assert e.upsert(f, 1_000, v) == 1
        assert e.upsert("f_int", 2_000, -7, "again") == 1 and e.upsert("f_int", 9_000, 5, "again") == 0
        assert {f: e.latest(f) for f in values} == values | {"f_int": -7}
        assert e.get()["f_none"] == (False, None) and e.get()["f_vec"] == (True, [1.25, -2.5, 3.75])
        e.delete("f_int", 3_000)
        assert e.latest("f_int") is None and e.latest("f_int", 5) == [] and e.get_range("f_int", (3_000, 1_000)) == [-7, 9223372036854775000]
        with pytest.raises(TypeError):
            e.latest_as("f_int", "double")
        with pytest.raises(NotFound):
            c.entity("prod", "NONE").latest("f_int")
        with pytest.raises(ValueError):
            e.latest("f_int", 0)


def test_registry():
    r = Registry()
    r.create(price())
    for bad in (price(), Feature("prod", "f_2", "price", "instrument", "double")):
        with pytest.raises(AlreadyExists):
            r.create(bad)
    with pytest.raises(ValueError):
        r.create(Feature("prod", "f_3", "x", "instrument", "unspecified"))
    assert r.update(Feature("prod", "f_price", "renamed", "other", "int64", owner="me")).feature_name == "price"
    r.create(Feature("prod", "f_z", "z", "portfolio", "double"))
    assert [f.feature_id for f in r.list("prod")] == ["f_price", "f_z"] and r.by_name("prod", "portfolio", "z").feature_id == "f_z"
    with pytest.raises(ValueError):
        r.create_group(Group("prod", "g", "g", "instrument", ("f_price", "f_z")))
    with pytest.raises(NotFound):
        r.create_group(Group("prod", "g", "g", "instrument", ("f_no",)))
    assert r.create_group(Group("prod", "g", "g", "instrument", ("f_price",))).features == ("f_price",)
    again = Registry.from_json(r.to_json())
    assert again.features == r.features and again.groups == r.groups


def test_config(tmp_path):
    (tmp_path / "c.conf").write_text("# note\ndata_dir = d\nbacklog=7\nunknown=1\nno value\n")
    c = Config.load(str(tmp_path / "c.conf"))
    assert c.backlog == 7 and c.data_dir == str(tmp_path / "d")
    (tmp_path / "bad.conf").write_text("backlog=x\n")
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "bad.conf"))
    with pytest.raises(FileNotFoundError):
        Config.load(str(tmp_path / "none.conf"))


def test_sources_and_stream(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "e.csv").write_text("entity_id,event_time_us,value,write_id\nAAPL,100,1.5,c1\nMSFT,2024-01-01 00:00:00,2.5,c2\n")
    csv = files.csv_events(spark, str(tmp_path / "e.csv"), "prod", "instrument", "f_price")
    assert {(r.entity_id, r.event_time_us, r.value.double_value) for r in csv.collect()} == {("AAPL", 100, 1.5), ("MSFT", 1704067200000000, 2.5)}
    table = pa.table({"entity_id": ["AAPL"], "event_time_us": [300], "value": [7.5], "write_id": ["a1"]})
    with pa.ipc.new_file(str(tmp_path / "e.arrow"), table.schema) as out:
        out.write_table(table)
    arrow = files.arrow_events(spark, str(tmp_path / "e.arrow"), "prod", "instrument", "f_price")
    assert arrow.first().value.double_value == 7.5
    with Store(spark, str(tmp_path / "s")) as s:
        s.register(price())
        csv.write.parquet(str(tmp_path / "in"))
        for _ in range(2):
            streaming.ingest(streaming.file_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
        streaming.ingest(streaming.file_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp2")).awaitTermination()
        assert s.events().count() == 2
        out = reads.latest(s.events()).select("entity_id", F.col("value.double_value").alias("v"))
        files.write_dataset(out, str(tmp_path / "d.arrow"), "ARROW_STREAM")
        with pa.ipc.open_stream(str(tmp_path / "d.arrow")) as back:
            assert back.read_all().num_rows == 2
        files.write_dataset(out, str(tmp_path / "d.parquet"))
        assert spark.read.parquet(str(tmp_path / "d.parquet")).count() == 2
    spark.createDataFrame([(1, "AAPL", 105)], "id int, who string, at bigint").write.parquet(str(tmp_path / "driving"))
    assert files.driving_table(spark, str(tmp_path / "driving"), row_id="id", entity_id="who", event_time="at").first().label_time_us == 105
