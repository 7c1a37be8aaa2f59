"""Registered queries that go through a real store: commits, a checkpoint, compaction, backup and restore.

Each store lies in the shared folder of the cluster. The facts are those of ``queries.facts``, written in
two commits: what happened before HALF, and the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duochron.functions import timeutil
from duochron.operators import reads
from duochron.plans.files import shared_dir
from duochron.plans.registry import Feature
from duochron.plans.store import Store
from duochron.queries import DAY, FACTS, HOUR, START, _t, _winner_sql, facts, feature_names, query
from duochron.schema import EVENT_INPUT, typed

HALF = START + 15 * DAY
#: The lsn of every event (each is a batch), and the sequence number of every fact, in the order of commits.
STAMPS = f"""{FACTS}, b as (select event_id, epoch_us(ts) >= {HALF} as late from events),
 l as (select event_id, row_number() over (order by late, event_id) as batch_lsn from b),
 s as (select f.*, batch_lsn, row_number() over (order by batch_lsn, f.sequence_no) as stamped_no from f join l on l.event_id = f.sequence_no // 2)"""


def _new(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts as input, one batch for each event."""
    event = F.expr("sequence_no div 2")
    return facts(spark, sf_dir).select(
        event.cast("string").alias("batch_id"), event.alias("arrival"), (F.col("sequence_no") % 2).cast("int").alias("position"), "tenant_id", "entity_type", "entity_id",
        "feature_id", "event_time_us", "system_time_us", "operation", typed("double", F.col("value")).alias("value"), "write_id", F.lit("queries").alias("source_id"),
    ).to(EVENT_INPUT)


def _register(store: Store, names: list[str]) -> None:
    store.register(*(Feature("prod", n, n, "user", "double", nullable=True, allow_external_system_time=True) for n in names))


_stores: dict[tuple[str, str], Store] = {}


def _loaded(spark: SparkSession, sf_dir: str) -> Store:
    """An open store of all facts, made once per session and table folder: the first commit is checkpointed, the second staged."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = _new(spark).__enter__()
        _register(store, feature_names(spark, sf_dir))
        rows = _batches(spark, sf_dir)
        store.write(rows.where(F.col("event_time_us") < HALF), trusted=True)
        store.checkpoint()
        store.write(rows.where(F.col("event_time_us") >= HALF), trusted=True)
        _stores[key] = store
    return _stores[key]


def _value(column: str = "value"):
    return F.col(f"{column}.double_value").alias("value")


@query(f"{_winner_sql()} select entity_id, feature_id, operation <> 'DELETE' as found, case when operation <> 'DELETE' then value end as value, event_time_us, system_time_us from w")
def store_latest(spark, sf):
    return reads.latest(_loaded(spark, sf).events()).select("entity_id", "feature_id", "found", _value(), "event_time_us", "system_time_us")


@query(f"{STAMPS} select write_id, batch_lsn as lsn, stamped_no as sequence_no from s")
def store_stamps(spark, sf):
    return _loaded(spark, sf).events().select("write_id", "lsn", "sequence_no")


@query(f"{FACTS} select write_id, entity_id, feature_id, value from f where event_time_us >= {HALF} and event_time_us between {START + 12 * DAY} and {START + 18 * DAY} and operation <> 'DELETE'")
def store_memory_range(spark, sf):
    return reads.range_events(_loaded(spark, sf).events("memory"), START + 12 * DAY, START + 18 * DAY).select("write_id", "entity_id", "feature_id", _value())


@query(f"{FACTS} select write_id, entity_id, value from f where feature_id = 'click' and event_time_us between {START + 12 * DAY} and {START + 18 * DAY} and operation <> 'DELETE'")
def store_disk_range(spark, sf):
    return reads.range_events(_loaded(spark, sf).events("disk", "prod", "click"), START + 12 * DAY, START + 18 * DAY).select("write_id", "entity_id", _value())


@query(f"{STAMPS} select feature_id, count(*) as n_rows, min(event_time_us) as min_event_time_us, max(event_time_us) as max_event_time_us, min(system_time_us) as min_system_time_us, max(batch_lsn) as max_lsn from s group by 1")
def segment_stats(spark, sf):
    return _loaded(spark, sf).stats().select("feature_id", F.col("rows").alias("n_rows"), "min_event_time_us", "max_event_time_us", "min_system_time_us", "max_lsn")


@query("select 'HEALTHY' as status, count(*) as lsn, cast(2 as bigint) as segments, cast(1 as bigint) as compactions_queued from events")
def health(spark, sf):
    said = _loaded(spark, sf).health()
    return spark.createDataFrame([(said["status"], said["lsn"], said["segments"], said["compactions_queued"])], "status string, lsn bigint, segments bigint, compactions_queued bigint")


@query("with n as (select count(*) as n from events) select lsn, lsn <= n as visible from (select unnest([1, n, n + 1]) as lsn, n from n)")
def lsn_fence(spark, sf):
    store = _loaded(spark, sf)

    def visible(lsn: int) -> bool:
        try:
            reads.at_least(store.events(), lsn)
        except ValueError:
            return False
        return True

    last = _t(spark, sf, "events").count()
    return spark.createDataFrame([(x, visible(x)) for x in (1, last, last + 1)], "lsn bigint, visible boolean")


#: The facts of every write id, ranked in their timelines; retention keeps the two newest and tombstones.
@query(f"{FACTS} select write_id, entity_id, value from (select *, row_number() over (partition by entity_id, feature_id order by event_time_us desc, system_time_us desc, sequence_no desc) as rn from f) where rn <= 2 or operation = 'DELETE'")
def store_compacted(spark, sf):
    with _new(spark) as store:
        _register(store, feature_names(spark, sf))
        rows = _batches(spark, sf)
        store.write(rows.where(F.col("event_time_us") < HALF), trusted=True)
        store.checkpoint()
        store.write(rows.where(F.col("event_time_us") >= HALF), trusted=True)
        store.compact("last_k", 2)
        return store.events().select("write_id", "entity_id", _value())


@query(f"{FACTS} select write_id, entity_id, operation, value from f where event_time_us < {HALF}")
def store_restored(spark, sf):
    with _new(spark) as store:
        _register(store, feature_names(spark, sf))
        rows = _batches(spark, sf)
        store.write(rows.where(F.col("event_time_us") < HALF), trusted=True)
        store.backup(f"{store.root}-backup")
        store.write(rows.where(F.col("event_time_us") >= HALF), trusted=True)
        store.restore(f"{store.root}-backup")
        return store.events().select("write_id", "entity_id", "operation", _value())


@query("""with e as (select event_id // 4 as g, event_id % 4 as p, case when event_id % 31 = 0 then 'INVALID_EVENT_TIME' when event_id % 29 = 0 then 'FEATURE_NOT_FOUND' end as err from events),
 b as (select g, count(*) as n, arg_min(err, p) filter (where err is not null) as error from e group by 1),
 w as (select 'a' || g as batch_id, n, error, false as seen from b union all select 'b' || g, n, error, g % 3 = 0 from b)
select batch_id, case when error is not null then 'REJECTED' when seen then 'DEDUPED' else 'ACCEPTED' end as status, case when error is null and not seen then n else 0 end as accepted_events, error from w""")
def store_reports(spark, sf):
    """Every event in a batch of four, written twice; a third of the batches repeat their write ids."""
    i, group = F.col("event_id"), F.expr("event_id div 4")
    rows = _t(spark, sf, "events")

    def batches(name: str, write_id):
        return rows.select(
            F.concat(F.lit(name), group).alias("batch_id"), group.alias("arrival"), (i % 4).cast("int").alias("position"), F.lit("prod").alias("tenant_id"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
            F.when(i % 29 == 0, "f_none").otherwise("f_value").alias("feature_id"), F.when(i % 31 == 0, 0).otherwise(START + i).cast("bigint").alias("event_time_us"), F.lit(None).cast("bigint").alias("system_time_us"), F.lit("UPSERT").alias("operation"),
            typed("double", F.col("value")).alias("value"), write_id.alias("write_id"), F.lit("queries").alias("source_id"),
        ).to(EVENT_INPUT)

    with _new(spark) as store:
        _register(store, ["f_value"])
        first = store.write(batches("a", F.concat(F.lit("w"), i)))
        second = store.write(batches("b", F.concat(F.when(group % 3 == 0, "w").otherwise("v"), i)))
        return first.unionByName(second)


@query(f"""{_winner_sql()}, q as (select unnest([0, 1, 2, 3]) as position, unnest(['view', 'click', 'none', 'view']) as feature_id), e as (select distinct entity_id from f)
select e.entity_id, position, q.feature_id, coalesce(operation <> 'DELETE', false) as found, case when operation <> 'DELETE' then value end as value
from e cross join q left join w on w.entity_id = e.entity_id and w.feature_id = q.feature_id""")
def request_order(spark, sf):
    """Every entity's answers in the order of a request, with a repeat and an unknown feature."""
    answers = reads.latest(facts(spark, sf)).select("entity_id", "feature_id", "found", "value")
    asked = F.posexplode(F.array(*map(F.lit, ("view", "click", "none", "view")))).alias("position", "feature_id")
    wanted = facts(spark, sf).select("entity_id").distinct().select("entity_id", asked)
    return wanted.join(answers, ["entity_id", "feature_id"], "left").select("entity_id", "position", "feature_id", F.coalesce("found", F.lit(False)).alias("found"), "value")


#: Text forms of times and what they say.
_TIMES = [("-5", -5), ("1704067200000000", START), ("2024:01:02:03:04:05", START + DAY + 3 * HOUR + 245_000_000), ("2024:01:02:03:04:05.25", START + DAY + 3 * HOUR + 245_250_000), ("2024-01-02 03:04:05", START + DAY + 3 * HOUR + 245_000_000), ("2024-01-02T03:04:05Z", START + DAY + 3 * HOUR + 245_000_000), ("2024-01-02T03:04:05+01:00", START + DAY + 2 * HOUR + 245_000_000), ("2024-01-02", START + DAY)]


@query("select * from (values " + ", ".join(f"('{text}', cast({us} as bigint))" for text, us in _TIMES) + ") as t(said, micros)")
def time_forms(spark, sf):
    return spark.createDataFrame([(text, timeutil.to_micros(text)) for text, _ in _TIMES], "said string, micros bigint")
