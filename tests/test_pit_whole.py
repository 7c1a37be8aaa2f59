"""Every event as a driving row, against the plain model."""

import pytest

from duochron import queries
from duochron.operators import pit, rolling
from tests.model import order, revisions, winner

SF = "/root/testdata/sf0.001"


def test_every_event_is_a_driving_row(spark):
    assert queries.driving(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert not any("event_id % 20" in sql for sql in queries.oracle_sql().values())


@pytest.fixture(scope="module")
def timelines(spark):
    """The events of one table as if few users had made them all: long timelines with a row at each event."""
    from pyspark.sql import functions as F

    hot = F.when(F.col("entity_id").cast("int") % 2 == 0, "1").when(F.col("entity_id").cast("int") % 3 == 0, "2").otherwise("3")
    facts = queries.facts(spark, SF).withColumn("entity_id", hot).cache()
    rows = queries.driving(spark, SF).withColumn("entity_id", hot).cache()
    by = {}
    for e in facts.collect():
        by.setdefault((e.entity_id, e.feature_id), []).append(e.asDict())
    return facts, rows, by, sorted({f for _, f in by})


def asked(strategy, r):
    return {"label": r.label_time_us, "shared": queries.S0, "few": queries.S0 + r.row_id % 3 * queries.DAY, "general": r.system_cutoff_us}[strategy]


@pytest.mark.parametrize("strategy", ["label", "shared", "few", "general"])
def test_strategies_equal_model_on_every_event(spark, timelines, strategy):
    from pyspark.sql import functions as F

    facts, rows, by, features = timelines
    cutoff = {"label": F.col("label_time_us"), "shared": F.lit(queries.S0), "few": queries.S0 + F.col("row_id") % 3 * queries.DAY, "general": F.col("system_cutoff_us")}[strategy]
    got = pit.point_in_time(rows.withColumn("system_cutoff_us", cutoff), facts, features, strategy=strategy).collect()
    want = {}
    for r in rows.collect():
        for f in features:
            w = winner(by[r.entity_id, f], r.label_time_us, asked(strategy, r))
            want[r.row_id, f] = (w is not None, w and w["value"], w and w["event_time_us"], w and w["system_time_us"])
    assert len(got) == len(want) and {(r.row_id, r.feature_id): (r.found, r.value, r.event_time_us, r.system_time_us) for r in got} == want


def test_rolling_equals_model_on_every_event(spark, timelines):
    facts, rows, by, features = timelines
    got = {(r.row_id, r.feature_id): (r.rolling_count, round(r.rolling_sum, 4) if r.rolling_sum is not None else None) for r in rolling.rolling_at(rows, facts, 3 * queries.DAY, ["count", "sum"]).collect()}
    want = {}
    for r in rows.collect():
        for f in features:
            near = [e for e in by[r.entity_id, f] if r.label_time_us - 3 * queries.DAY < e["event_time_us"] <= r.label_time_us]
            known = sorted(revisions(near, r.system_cutoff_us), key=order)
            values = [e["value"] for e in known if e["value"] is not None]
            if known:
                want[r.row_id, f] = (len(values), round(sum(values), 4) if values else None)
    assert set(got) == set(want)
    assert all(got[k][0] == n and (got[k][1] == v or abs(got[k][1] - v) < 1e-3) for k, (n, v) in want.items())
