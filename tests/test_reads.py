import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duochron.operators import pit, reads, rolling
from tests import model

DDL = "tenant_id string, entity_type string, entity_id string, feature_id string, event_time_us bigint, system_time_us bigint, sequence_no bigint, lsn bigint, operation string, value double, write_id string"


def event(n, op, value, e, s, feature="f_price", entity="AAPL"):
    return {"tenant_id": "prod", "entity_type": "instrument", "entity_id": entity, "feature_id": feature, "event_time_us": e, "system_time_us": s, "sequence_no": n, "lsn": n, "operation": op, "value": value, "write_id": f"w{n}"}


EXAMPLE = [event(1, "UPSERT", 1.0, 100, 110), event(2, "UPSERT", 2.0, 100, 120), event(3, "UPSERT", 3.0, 130, 130), event(4, "DELETE", 0.0, 130, 140), event(5, "UPSERT", 4.0, 140, 150)]


def frame(spark, events):
    return spark.createDataFrame(events, DDL)


@pytest.mark.parametrize(("upto", "e", "s", "value"), [(3, 105, 115, 1.0), (3, 105, 125, 2.0), (3, 140, 200, 3.0), (4, 140, 150, None), (5, 140, 150, 4.0)])
def test_as_of_example(spark, upto, e, s, value):
    row = reads.as_of(frame(spark, EXAMPLE[:upto]), e, s).first()
    assert (row.value, row.found) == (value, value is not None)


def test_latest_and_history_example(spark):
    assert not reads.latest(frame(spark, EXAMPLE[:4])).first().found
    assert reads.latest_n(frame(spark, EXAMPLE[:4]), 3).count() == 0
    assert [r.value for r in reads.latest_n(frame(spark, EXAMPLE), 4).orderBy("rank").collect()] == [4.0, 3.0, 2.0, 1.0]


def test_arguments(spark):
    with pytest.raises(ValueError):
        reads.latest_n(frame(spark, EXAMPLE), 0)
    with pytest.raises(ValueError):
        reads.range_events(frame(spark, EXAMPLE), 10, 5)
    with pytest.raises(ValueError):
        reads.at_least(frame(spark, EXAMPLE), 6)
    assert reads.at_least(frame(spark, EXAMPLE), 5).count() == 5


def test_null_is_found_and_tombstone_is_not(spark):
    rows = {r.feature_id: r for r in reads.latest(frame(spark, [event(1, "UPSERT", None, 1, 1, "a"), event(2, "DELETE", 5.0, 1, 1, "b")])).collect()}
    assert (rows["a"].found, rows["a"].value) == (True, None)
    assert (rows["b"].found, rows["b"].value) == (False, None)


def test_range_keeps_revisions(spark):
    found = reads.newest_first(reads.range_events(frame(spark, EXAMPLE), 100, 130)).collect()
    assert [r.value for r in found] == [3.0, 2.0, 1.0]


def test_request_order_and_repeats(spark):
    answers = reads.latest(frame(spark, EXAMPLE))
    rows = reads.requested(spark, answers, {"tenant_id": "prod", "entity_type": "instrument", "entity_id": "AAPL"}, ["f_x", "f_price", "f_x", "f_price"]).collect()
    assert [(r.feature_id, r.found) for r in rows] == [("f_x", False), ("f_price", True)] * 2


def test_snapshot_has_every_feature(spark):
    features = spark.createDataFrame([("prod", "instrument", "f_price"), ("prod", "instrument", "f_note"), ("prod", "other", "f_z")], "tenant_id string, entity_type string, feature_id string")
    entities = spark.createDataFrame([("prod", "instrument", "AAPL"), ("prod", "instrument", "NONE")], "tenant_id string, entity_type string, entity_id string")
    got = {(r.entity_id, r.feature_id): r.found for r in reads.entity_snapshot(frame(spark, EXAMPLE), features, entities, "instrument").collect()}
    assert got == {("AAPL", "f_price"): True, ("AAPL", "f_note"): False, ("NONE", "f_price"): False, ("NONE", "f_note"): False}


def test_audit_names_the_replacing_write(spark):
    got = {r.write_id: r.replaced_by for r in reads.audit_history(frame(spark, EXAMPLE), 0, 1000).collect()}
    assert got == {"w1": "w2", "w2": None, "w3": "w4", "w4": None, "w5": None}


def test_plan_prunes_and_pushes(spark, tmp_path):
    frame(spark, EXAMPLE).write.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = reads.as_of(spark.read.parquet(str(tmp_path / "f")), 140, 150, ["lsn"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_time_us,140)" in plan and "LessThanOrEqual(system_time_us,150)" in plan
    assert "write_id" not in plan.split("ReadSchema")[1]


def random_events(seed, n=250):
    rng = random.Random(seed)
    return [event(i, "DELETE" if rng.random() < 0.2 else "UPSERT", None if rng.random() < 0.1 else float(rng.randrange(100)), rng.randrange(1, 40), rng.randrange(1, 40), rng.choice("ab"), rng.choice("xyz")) for i in range(n)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_all_strategies_equal_the_model(spark, seed):
    events = random_events(seed)
    rng = random.Random(seed + 1)
    rows = [(i, "prod", "instrument", rng.choice("xyz"), t := rng.randrange(1, 45), rng.choice([t, 10, 20, 30])) for i in range(40)]
    facts = frame(spark, events)
    driving = spark.createDataFrame(rows, "row_id int, tenant_id string, entity_type string, entity_id string, label_time_us bigint, system_cutoff_us bigint")

    def expected(cut):
        out = {}
        for i, _, _, x, t, s in rows:
            for f in "ab":
                w = model.winner([e for e in events if (e["entity_id"], e["feature_id"]) == (x, f)], t, cut(t, s))
                out[i, f] = (w is not None, w and w["value"], w and w["event_time_us"], w and w["system_time_us"])
        return out

    def got(frame, strategy, default=None):
        return {(r.row_id, r.feature_id): (r.found, r.value, r.event_time_us, r.system_time_us) for r in pit.point_in_time(frame, facts, ["a", "b"], default, strategy).collect()}

    assert got(driving, "general") == expected(lambda t, s: s)
    same = driving.withColumn("system_cutoff_us", F.col("label_time_us"))
    assert got(same, "label") == got(same, "general") == expected(lambda t, s: t)
    assert got(driving.drop("system_cutoff_us"), "shared", 20) == expected(lambda t, s: 20)
    few = driving.withColumn("system_cutoff_us", F.when(F.col("row_id") % 2 == 0, 10).otherwise(30))
    assert got(few, "few") == got(few, "general")


def test_chooser_and_missing_cutoff(spark):
    d = spark.createDataFrame([(1, "prod", "instrument", "AAPL", 105, 115), (2, "prod", "instrument", "AAPL", 115, None)], "row_id int, tenant_id string, entity_type string, entity_id string, label_time_us bigint, system_cutoff_us bigint")
    with pytest.raises(ValueError):
        pit.point_in_time(d, frame(spark, EXAMPLE), ["f_price"])
    assert pit.choose(d, 130) == "few"
    assert pit.choose(d.drop("system_cutoff_us"), 130) == "shared"
    assert pit.choose(d.withColumn("system_cutoff_us", F.col("label_time_us"))) == "label"
    got = {r.row_id: r.value for r in pit.point_in_time(d, frame(spark, EXAMPLE), ["f_price"], 130).collect()}
    assert got == {1: 1.0, 2: 2.0}


def test_wide_defaults_and_presence(spark):
    d = spark.createDataFrame([(1, "prod", "instrument", "AAPL", 105), (2, "prod", "instrument", "NONE", 105)], "row_id int, tenant_id string, entity_type string, entity_id string, label_time_us bigint")
    long = pit.point_in_time(d, frame(spark, EXAMPLE), ["f_price", "f_x"], 200)
    assert {r.row_id: (r.f_price, r.f_x) for r in pit.wide(long, ["f_price", "f_x"]).collect()} == {1: (2.0, None), 2: (None, None)}
    assert {(r.row_id, r.feature_id): r.value for r in pit.with_defaults(long, {"f_x": 9.0}).collect()}[2, "f_x"] == 9.0
    assert [r.row_id for r in pit.complete_rows(pit.point_in_time(d, frame(spark, EXAMPLE), ["f_price"], 200), ["f_price"]).collect()] == [1]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_equals_the_model(spark, seed):
    events = random_events(seed)
    got = {(r.entity_id, r.feature_id, r.event_time_us): (r.rolling_count, r.rolling_sum) for r in rolling.rolling(frame(spark, events), 7, 25, ["count", "sum"]).collect()}
    want = {}
    for x in "xyz":
        for f in "ab":
            seen = model.revisions([e for e in events if (e["entity_id"], e["feature_id"]) == (x, f)], 25)
            for e in seen:
                held = [o["value"] for o in seen if e["event_time_us"] - 7 < o["event_time_us"] <= e["event_time_us"] and o["value"] is not None]
                want[x, f, e["event_time_us"]] = (len(held), sum(held) if held else None)
    assert got == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert reads.latest(none).count() == reads.latest_n(none, 2).count() == reads.window_scan(none, 0, 9, 9).count() == 0
    d = spark.createDataFrame([(1, "prod", "instrument", "AAPL", 105)], "row_id int, tenant_id string, entity_type string, entity_id string, label_time_us bigint")
    assert [r.found for r in pit.point_in_time(d, none, ["f"], 1).collect()] == [False]
