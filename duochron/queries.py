"""The registered queries of the engine's own operators, each with the SQL that says the same.

They run on facts derived from the tables: ``events`` gives numeric features per user with corrections,
tombstones and nulls; ``embeddings`` vector features, ``conversations`` text features, ``orders`` features
of customers. Sums of doubles are rounded, since their order isn't fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duochron.functions import literals, timeutil
from duochron.operators import ingest, pit, reads, rolling
from duochron.plans.files import shared_dir
from duochron.schema import DELETE, UPSERT

HOUR, DAY = 3_600_000_000, 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
E0, S0 = START + 15 * DAY, START + 16 * DAY
EARLY = START + 15 * DAY + HOUR
FEATURES_SQL = "(select distinct event_type as feature_id from events)"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over events: each row makes its base fact, and every fourth a correction."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("feature_id"), at.alias("event_time_us"), "value")
    i = F.col("event_id")
    first = F.col("event_time_us") + (i % 7) * HOUR
    gone = F.when(i % 10 == 9, DELETE).otherwise(UPSERT)
    gone_later = F.when(i % 40 == 20, DELETE).otherwise(UPSERT)
    base = F.struct(first.alias("system_time_us"), (i * 2).alias("sequence_no"), gone.alias("operation"), F.when((gone == DELETE) | (i % 50 == 3), None).otherwise(F.col("value")).alias("value"), F.concat(F.lit("e"), i).alias("write_id"))
    late = F.struct((first + DAY * (1 + i % 3)).alias("system_time_us"), (i * 2 + 1).alias("sequence_no"), gone_later.alias("operation"), F.when(gone_later == DELETE, None).otherwise(F.col("value") + 1000).alias("value"), F.concat(F.lit("c"), i).alias("write_id"))
    rows = e.withColumn("r", F.explode(F.when(i % 4 == 0, F.array(base, late)).otherwise(F.array(base))))
    return rows.select(F.lit("prod").alias("tenant_id"), F.lit("user").alias("entity_type"), "entity_id", "feature_id", "event_time_us", "r.*").withColumn("lsn", F.col("sequence_no"))


FACTS = f"""with f as (
  select 'prod' as tenant_id, 'user' as entity_type, cast(user_id as varchar) as entity_id, event_type as feature_id, epoch_us(ts) as event_time_us,
    epoch_us(ts) + (event_id % 7) * {HOUR} as system_time_us, event_id * 2 as sequence_no, case when event_id % 10 = 9 then 'DELETE' else 'UPSERT' end as operation,
    case when event_id % 10 = 9 or event_id % 50 = 3 then null else value end as value, 'e' || event_id as write_id, event_id * 2 as lsn from events
  union all
  select 'prod', 'user', cast(user_id as varchar), event_type, epoch_us(ts), epoch_us(ts) + (event_id % 7) * {HOUR} + {DAY} * (1 + event_id % 3), event_id * 2 + 1,
    case when event_id % 40 = 20 then 'DELETE' else 'UPSERT' end, case when event_id % 40 = 20 then null else value + 1000 end, 'c' || event_id, event_id * 2 + 1 from events where event_id % 4 = 0
)"""
NEWEST = "order by event_time_us desc, system_time_us desc, sequence_no desc"


def _winner_sql(where: str = "true") -> str:
    return f"{FACTS}, w as (select * from (select *, row_number() over (partition by entity_id, feature_id {NEWEST}) as rn from f where {where}) where rn = 1)"


def driving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a driving row."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _t(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("row_id"), F.lit("prod").alias("tenant_id"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), (us + HOUR // 2).alias("label_time_us"), (us + (F.col("event_id") % 5) * (DAY // 2)).alias("system_cutoff_us"))


DRIVING = f", d as (select event_id as row_id, cast(user_id as varchar) as entity_id, epoch_us(ts) + {HOUR // 2} as label_time_us, epoch_us(ts) + (event_id % 5) * {DAY // 2} as system_cutoff_us from events)"


def feature_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types: the registered features of the example, a handful by nature."""
    return sorted(r[0] for r in _t(spark, sf_dir, "events").select("event_type").distinct().collect())


def _pit_sql(cutoff: str, tail: str = "select row_id, entity_id, feature_id, found, value, event_time_us, system_time_us from p") -> str:
    return f"""{FACTS}{DRIVING}, a as (select d.row_id, d.entity_id, d.label_time_us, {cutoff} as s, t.feature_id from d cross join {FEATURES_SQL} t),
 j as (select a.row_id, a.entity_id, a.feature_id, f.operation, f.value, f.event_time_us, f.system_time_us,
   row_number() over (partition by a.row_id, a.feature_id order by f.event_time_us desc nulls last, f.system_time_us desc nulls last, f.sequence_no desc nulls last) as rn
   from a left join f on f.entity_id = a.entity_id and f.feature_id = a.feature_id and f.event_time_us <= a.label_time_us and f.system_time_us <= a.s),
 p as (select row_id, entity_id, feature_id, coalesce(operation <> 'DELETE', false) as found, case when operation <> 'DELETE' then value end as value,
   case when operation <> 'DELETE' then event_time_us end as event_time_us, case when operation <> 'DELETE' then system_time_us end as system_time_us from j where rn = 1)
{tail}"""


PIT_COLUMNS = ("row_id", "entity_id", "feature_id", "found", "value", "event_time_us", "system_time_us")
_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        _found[f.__name__] = (f, sql)
        return f

    return add


ANSWER = "entity_id, feature_id, operation <> 'DELETE' as found, case when operation <> 'DELETE' then value end as value, event_time_us, system_time_us"
ANSWER_COLUMNS = ("entity_id", "feature_id", "found", "value", "event_time_us", "system_time_us")


@query(f"{_winner_sql()} select {ANSWER} from w")
def latest(spark, sf):
    return reads.latest(facts(spark, sf)).select(*ANSWER_COLUMNS)


@query(f"{_winner_sql()} select entity_id, count(*) filter (where operation <> 'DELETE') as n_found, count(*) filter (where operation = 'DELETE') as n_missing from w group by 1")
def latest_found_flag(spark, sf):
    return reads.latest(facts(spark, sf)).groupBy("entity_id").agg(F.count_if("found").alias("n_found"), F.count_if(~F.col("found")).alias("n_missing"))


@query(f"{_winner_sql()}, r as (select f.*, row_number() over (partition by entity_id, feature_id {NEWEST}) as rank from f where operation <> 'DELETE' and (entity_id, feature_id) not in (select (entity_id, feature_id) from w where operation = 'DELETE')) select entity_id, feature_id, rank, value, write_id from r where rank <= 4")
def latest_n(spark, sf):
    return reads.latest_n(facts(spark, sf), 4).select("entity_id", "feature_id", "rank", "value", "write_id")


@query(f"{FACTS} select entity_id, feature_id, event_time_us, value, write_id from f where operation <> 'DELETE' and event_time_us between {START + 5 * DAY} and {START + 9 * DAY}")
def range_closed(spark, sf):
    return reads.range_events(facts(spark, sf), START + 5 * DAY, START + 9 * DAY).select("entity_id", "feature_id", "event_time_us", "value", "write_id")


@query(f"{FACTS} select entity_id, feature_id, event_time_us, value, write_id from f where operation <> 'DELETE' and event_time_us >= {START + 20 * DAY}")
def range_open(spark, sf):
    return reads.range_events(facts(spark, sf), START + 20 * DAY).select("entity_id", "feature_id", "event_time_us", "value", "write_id")


@query(f"{_winner_sql()}, g as (select * from (select distinct entity_id from f) cross join {FEATURES_SQL}) select g.entity_id, g.feature_id, coalesce(w.operation <> 'DELETE', false) as found, case when w.operation <> 'DELETE' then w.value end as value from g left join w using (entity_id, feature_id)")
def entity_snapshot(spark, sf):
    f = facts(spark, sf)
    features = f.select("tenant_id", "entity_type", "feature_id").distinct()
    return reads.entity_snapshot(f, features, f, "user").select("entity_id", "feature_id", "found", "value")


@query(f"{_winner_sql(f'event_time_us <= {E0} and system_time_us <= {S0}')} select {ANSWER} from w")
def as_of(spark, sf):
    return reads.as_of(facts(spark, sf), E0, S0).select(*ANSWER_COLUMNS)


@query(f"{_winner_sql(f'event_time_us <= {E0} and system_time_us <= {EARLY - 5 * DAY}')} select {ANSWER} from w")
def as_of_early_system_cutoff(spark, sf):
    return reads.as_of(facts(spark, sf), E0, EARLY - 5 * DAY).select(*ANSWER_COLUMNS)


@query(f"{_winner_sql(f'event_time_us <= {E0} and system_time_us <= {S0}')} select entity_id, feature_id, write_id from w where operation = 'DELETE'")
def as_of_tombstone(spark, sf):
    return reads.as_of(facts(spark, sf), E0, S0).where(~F.col("found")).select("entity_id", "feature_id", "write_id")


@query(f"{FACTS} select entity_id, feature_id, event_time_us, system_time_us, operation, value, write_id, lead(write_id) over (partition by entity_id, feature_id, event_time_us order by system_time_us, sequence_no) as replaced_by from f where event_time_us between {START + 3 * DAY} and {START + 12 * DAY}")
def audit_history(spark, sf):
    return reads.audit_history(facts(spark, sf), START + 3 * DAY, START + 12 * DAY).select("entity_id", "feature_id", "event_time_us", "system_time_us", "operation", "value", "write_id", "replaced_by")


def _visible_sql(s: int, where: str = "true") -> str:
    return f"{FACTS}, v as (select * from (select *, row_number() over (partition by entity_id, feature_id, event_time_us order by system_time_us desc, sequence_no desc) as rn from f where system_time_us <= {s} and {where}) where rn = 1 and operation <> 'DELETE')"


@query(f"{_visible_sql(S0, f'event_time_us between {START + 2 * DAY} and {START + 14 * DAY}')} select entity_id, feature_id, event_time_us, system_time_us, value from v")
def window_scan_visible(spark, sf):
    return reads.window_scan(facts(spark, sf), START + 2 * DAY, START + 14 * DAY, S0).select("entity_id", "feature_id", "event_time_us", "system_time_us", "value")


@query(_pit_sql(str(S0)))
def pit_shared_cutoff(spark, sf):
    return pit.point_in_time(driving(spark, sf).drop("system_cutoff_us"), facts(spark, sf), feature_names(spark, sf), S0).select(*PIT_COLUMNS)


@query(_pit_sql("d.system_cutoff_us"))
def pit_row_cutoff(spark, sf):
    return pit.point_in_time(driving(spark, sf), facts(spark, sf), feature_names(spark, sf)).select(*PIT_COLUMNS)


@query(_pit_sql("d.label_time_us"))
def pit_label_cutoff(spark, sf):
    return pit.point_in_time(driving(spark, sf).withColumn("system_cutoff_us", F.col("label_time_us")), facts(spark, sf), feature_names(spark, sf), strategy="label").select(*PIT_COLUMNS)


@query(_pit_sql(f"case when d.row_id % 3 = 0 then {S0} else {S0 + 5 * DAY} end"))
def pit_few_cutoffs(spark, sf):
    rows = driving(spark, sf).withColumn("system_cutoff_us", F.when(F.col("row_id") % 3 == 0, S0).otherwise(S0 + 5 * DAY))
    return pit.point_in_time(rows, facts(spark, sf), feature_names(spark, sf), strategy="few").select(*PIT_COLUMNS)


@query(_pit_sql("d.label_time_us", "select row_id, max(case when feature_id = 'click' then value end) as click_value, max(case when feature_id = 'purchase' then value end) as purchase_value from p group by row_id"))
def pit_wide(spark, sf):
    rows = driving(spark, sf).withColumn("system_cutoff_us", F.col("label_time_us"))
    long = pit.point_in_time(rows, facts(spark, sf), ["click", "purchase"], strategy="label")
    return pit.wide(long, ["click", "purchase"]).select("row_id", F.col("click").alias("click_value"), F.col("purchase").alias("purchase_value"))


@query(_pit_sql("d.label_time_us", "select row_id, feature_id, found, case when feature_id = 'click' and not found then -1.0 else value end as value from p"))
def pit_default_fill(spark, sf):
    rows = driving(spark, sf).withColumn("system_cutoff_us", F.col("label_time_us"))
    long = pit.point_in_time(rows, facts(spark, sf), feature_names(spark, sf), strategy="label")
    return pit.with_defaults(long, {"click": -1.0}).select("row_id", "feature_id", "found", "value")


@query(_pit_sql("d.label_time_us", "select row_id, feature_id, value from p where row_id in (select row_id from p where feature_id in ('click', 'view') group by row_id having count(*) filter (where found) = 2) and feature_id in ('click', 'view')"))
def pit_require_all(spark, sf):
    rows = driving(spark, sf).withColumn("system_cutoff_us", F.col("label_time_us"))
    long = pit.point_in_time(rows, facts(spark, sf), ["click", "view"], strategy="label")
    return pit.complete_rows(long, ["click", "view"]).select("row_id", "feature_id", "value")


@query(_pit_sql("d.label_time_us", "select row_id, feature_id, found, value from p where feature_id in ('click', 'view')"))
def pit_group(spark, sf):
    members = spark.createDataFrame([("prod", "g_serving", "view"), ("prod", "g_serving", "click"), ("prod", "g_other", "purchase")], "tenant_id string, group_id string, feature_id string")
    rows = driving(spark, sf).withColumn("system_cutoff_us", F.col("label_time_us"))
    return pit.point_in_time(rows, facts(spark, sf), pit.group_features(members, "prod", "g_serving"), strategy="label").select("row_id", "feature_id", "found", "value")


def _rolling_sql(columns: str, frame: str = f"range between {3 * DAY - 1} preceding and current row") -> str:
    return f"{_visible_sql(S0)} select entity_id, feature_id, event_time_us, {columns.replace('@', f'over (partition by entity_id, feature_id order by event_time_us {frame})')} from v"


def _rolled(spark, sf, *aggregates):
    return rolling.rolling(facts(spark, sf), 3 * DAY, S0, list(aggregates))


@query(_rolling_sql("round(avg(value) @, 6) as rolling_mean"))
def rolling_mean(spark, sf):
    return _rolled(spark, sf, "mean").select("entity_id", "feature_id", "event_time_us", F.round("rolling_mean", 6).alias("rolling_mean"))


@query(_rolling_sql("round(sum(value) @, 4) as rolling_sum"))
def rolling_sum(spark, sf):
    return _rolled(spark, sf, "sum").select("entity_id", "feature_id", "event_time_us", F.round("rolling_sum", 4).alias("rolling_sum"))


@query(_rolling_sql("count(value) @ as rolling_count"))
def rolling_count(spark, sf):
    return _rolled(spark, sf, "count").select("entity_id", "feature_id", "event_time_us", "rolling_count")


@query(_rolling_sql("min(value) @ as rolling_min, max(value) @ as rolling_max"))
def rolling_minmax(spark, sf):
    return _rolled(spark, sf, "min", "max").select("entity_id", "feature_id", "event_time_us", "rolling_min", "rolling_max")


@query(_rolling_sql("round(avg(value) @, 6) as last_n_mean, count(value) @ as last_n_count", "rows between 4 preceding and current row"))
def rolling_last_n(spark, sf):
    return rolling.rolling_last_n(facts(spark, sf), 5, S0).select("entity_id", "feature_id", "event_time_us", F.round("last_n_mean", 6).alias("last_n_mean"), "last_n_count")


@query(f"""{FACTS}{DRIVING}, m as (select d.row_id, f.*, row_number() over (partition by d.row_id, f.feature_id, f.event_time_us order by f.system_time_us desc, f.sequence_no desc) as rn from d join f on f.entity_id = d.entity_id
  and f.event_time_us > d.label_time_us - {3 * DAY} and f.event_time_us <= d.label_time_us and f.system_time_us <= d.system_cutoff_us)
select row_id, feature_id, count(value) as rolling_count, round(sum(value), 4) as rolling_sum from m where rn = 1 and operation <> 'DELETE' group by 1, 2""")
def rolling_row_cutoff(spark, sf):
    return rolling.rolling_at(driving(spark, sf), facts(spark, sf), 3 * DAY, ["count", "sum"]).select("row_id", "feature_id", "rolling_count", F.round("rolling_sum", 4).alias("rolling_sum"))


@query(_rolling_sql("round(case when stddev_pop(value) @ > 1e-6 then (value - avg(value) @) / (stddev_pop(value) @) end, 3) as z_score"))
def zscore(spark, sf):
    z = rolling.z_score(facts(spark, sf), 3 * DAY, S0)
    return z.select("entity_id", "feature_id", "event_time_us", F.round("z_score", 3).alias("z_score"))


@query(f"{_winner_sql()}, x as (select entity_id, max(case when feature_id = 'click' and operation <> 'DELETE' then value end) as n, max(case when feature_id = 'view' and operation <> 'DELETE' then value end) as d from w where feature_id in ('click', 'view') group by 1) select entity_id, case when d <> 0 then round(n / d, 6) end as ratio from x")
def ratio(spark, sf):
    return rolling.ratio(reads.latest(facts(spark, sf)), "click", "view").select("entity_id", F.round("ratio", 6).alias("ratio"))


@query(f"{FACTS}, p as (select entity_id, feature_id, event_time_us, count(*) as n, count(*) filter (where operation = 'DELETE') as d from f group by 1, 2, 3) select entity_id, feature_id, count(*) as event_times, cast(sum(n - 1) as bigint) as corrections, cast(sum(d) as bigint) as tombstones from p group by 1, 2")
def correction_report(spark, sf):
    return reads.correction_report(facts(spark, sf)).select("entity_id", "feature_id", "event_times", "corrections", "tombstones")


@query(f"{_winner_sql()} select entity_id, feature_id, operation <> 'DELETE' and {START + 31 * DAY} - event_time_us > {5 * DAY} as is_stale from w")
def freshness_stale(spark, sf):
    return reads.with_freshness(reads.latest(facts(spark, sf)), START + 31 * DAY, 5 * DAY).select("entity_id", "feature_id", "is_stale")


@query(f"{FACTS}, t as (select * from f union all select tenant_id, entity_type, entity_id, feature_id, event_time_us + 1, system_time_us, sequence_no + 1000000000, operation, value, write_id, lsn + 1000000000 from f where lsn % 3 = 0) select write_id, entity_id, event_time_us from (select *, row_number() over (partition by write_id order by lsn, sequence_no) as rn from t) where rn = 1")
def dedupe_write_id(spark, sf):
    f = facts(spark, sf)
    again = f.where(F.col("lsn") % 3 == 0).withColumns({"event_time_us": F.col("event_time_us") + 1, "sequence_no": F.col("sequence_no") + 1_000_000_000, "lsn": F.col("lsn") + 1_000_000_000})
    return ingest.dedupe_events(f.unionByName(again)).select("write_id", "entity_id", "event_time_us")


def _written(df: DataFrame) -> DataFrame:
    """Written down in the cluster's shared folder; checkpoint() keeps the rows as they are."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@query("""with recursive r as (select event_id as batch_id, event_id // 12 as block, event_id % 12 as k, list_distinct([event_id // 12 * 100 + event_id * 7 % 13, event_id // 12 * 100 + event_id * 5 % 13]) as ws from events),
 step as (select distinct block, cast(-1 as bigint) as k, cast([] as bigint[]) as taken, cast(null as bigint) as accepted from r
   union all select s.block, r.k, case when list_has_any(s.taken, r.ws) then s.taken else list_concat(s.taken, r.ws) end, case when list_has_any(s.taken, r.ws) then null else r.batch_id end from step s join r on r.block = s.block and r.k = s.k + 1)
select accepted as batch_id from step where accepted is not null""")
def dedupe_batch(spark, sf):
    i, block = F.col("event_id"), F.floor(F.col("event_id") / 12) * 100
    batches = _t(spark, sf, "events").select(i.alias("batch_id"), i.alias("arrival"), F.explode(F.array_distinct(F.array(block + i * 7 % 13, block + i * 5 % 13)).cast("array<string>")).alias("write_id"))
    return ingest.admitted(batches, spark.createDataFrame([], "write_id string"), _written)


@query("""select event_id, case when user_id % 11 = 0 then 'INVALID_ENTITY' when event_id % 13 = 0 then 'INVALID_EVENT_TIME' when event_id % 17 = 0 then 'INVALID_WRITE_ID' when event_id % 19 = 0 then 'FEATURE_NOT_FOUND' when event_id % 23 = 0 then 'NULL_NOT_ALLOWED' end as error from events""")
def validate_batch(spark, sf):
    from duochron.schema import typed

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    i = F.col("event_id")
    rows = _t(spark, sf, "events").select("event_id", F.lit("prod").alias("tenant_id"), F.lit("user").alias("entity_type"), F.when(F.col("user_id") % 11 == 0, "").otherwise(F.col("user_id").cast("string")).alias("entity_id"), F.when(i % 19 == 0, "f_none").otherwise("f_value").alias("feature_id"), F.when(i % 13 == 0, 0).otherwise(F.unix_micros(F.col("ts").cast("timestamp"))).alias("event_time_us"), F.lit(None).cast("bigint").alias("system_time_us"), F.lit(UPSERT).alias("operation"), typed("double", F.when(i % 23 == 0, None).otherwise(F.coalesce("value", F.lit(0.0)))).alias("value"), F.when(i % 17 == 0, "").otherwise(i.cast("string")).alias("write_id"))
    registry = spark.createDataFrame([("prod", "f_value", "user", "double", False, True)], "tenant_id string, feature_id string, entity_type string, value_type string, nullable boolean, allow_external_system_time boolean")
    return ingest.validated(rows, registry).select("event_id", "error")


@query(f"{FACTS} select entity_id, count(*) as n_rows, count(distinct write_id) as n_writes, max(lsn) as max_lsn from f group by 1")
def compaction_rows(spark, sf):
    f = facts(spark, sf)
    return ingest.dedupe_events(f.unionByName(f)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("write_id").alias("n_writes"), F.max("lsn").alias("max_lsn"))


@query(f"{FACTS} select write_id from (select *, row_number() over (partition by entity_id, feature_id {NEWEST}) as rn from f) where rn <= 3 or operation = 'DELETE'")
def retention_last_k(spark, sf):
    return ingest.retained(facts(spark, sf), "last_k", 3).select("write_id")


@query(f"{FACTS} select write_id from f where event_time_us > {START + 31 * DAY} - 7 * {DAY} or operation = 'DELETE'")
def retention_days(spark, sf):
    return ingest.retained(facts(spark, sf), "days", 7, START + 31 * DAY).select("write_id")


@query(f"{FACTS} select write_id from (select *, row_number() over (partition by entity_id, feature_id {NEWEST}) as rn from f) where rn = 1 or operation = 'DELETE' or event_time_us > {START + 31 * DAY} - 7 * {DAY}")
def retention_latest_after(spark, sf):
    return ingest.retained(facts(spark, sf), "latest_after", 7, START + 31 * DAY).select("write_id")


@query(f"{_winner_sql()} select entity_id, max(lsn) as lsn, max(system_time_us) as system_time_us from w group by 1")
def visible_commit(spark, sf):
    return reads.visible_commit(facts(spark, sf)).select("entity_id", "lsn", "system_time_us")


@query("select distinct 'user' as entity_type, event_type as feature_name from events")
def registry_list(spark, sf):
    from duochron.plans.registry import Feature, Registry

    r = Registry()
    for name in feature_names(spark, sf):
        r.create(Feature("prod", f"f_{name}", name, "user", "double"))
    return r.feature_table(spark).where("tenant_id = 'prod'").select("entity_type", "feature_name")


@query("select 'g_all' as group_id, 'f_' || event_type as feature_id from events group by event_type")
def group_members(spark, sf):
    from duochron.plans.registry import Feature, Group, Registry

    r = Registry()
    for name in feature_names(spark, sf):
        r.create(Feature("prod", f"f_{name}", name, "user", "double"))
    r.create_group(Group("prod", "g_all", "all", "user", tuple(f"f_{n}" for n in feature_names(spark, sf))))
    return r.member_table(spark).select("group_id", "feature_id")


@query("select vec_id, len(embedding) as width, round(list_sum(cast(embedding as double[])), 4) as total from embeddings")
def vector_latest(spark, sf):
    e = _t(spark, sf, "embeddings")
    rows = e.select(F.lit("prod").alias("tenant_id"), F.lit("vector").alias("entity_type"), F.col("vec_id").cast("string").alias("entity_id"), F.lit("f_vec").alias("feature_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("event_time_us"), F.col("vec_id").alias("sequence_no"), F.lit(UPSERT).alias("operation"), F.col("embedding").alias("value")).withColumn("system_time_us", F.col("event_time_us"))
    total = F.aggregate("value", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return reads.latest(rows).select(F.col("entity_id").cast("bigint").alias("vec_id"), F.size("value").alias("width"), F.round(total, 4).alias("total"))


@query("select conv_id, text as last_text from (select *, row_number() over (partition by conv_id order by turn desc, text desc) as rn from conversations) where rn = 1")
def string_latest(spark, sf):
    c = _t(spark, sf, "conversations")
    rows = c.select(F.lit("prod").alias("tenant_id"), F.lit("conversation").alias("entity_type"), F.col("conv_id").cast("string").alias("entity_id"), F.lit("f_text").alias("feature_id"), F.col("turn").alias("event_time_us"), F.lit(0).alias("system_time_us"), F.col("text").alias("sequence_no"), F.lit(UPSERT).alias("operation"), F.col("text").alias("value"))
    return reads.latest(rows).select(F.col("entity_id").cast("bigint").alias("conv_id"), F.col("value").alias("last_text"))


@query("select c_custkey, last_price from (select o_custkey as c_custkey, o_totalprice as last_price, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def customer_latest_order(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = _t(spark, sf, "orders")
    rows = o.select(F.lit("prod").alias("tenant_id"), F.lit("customer").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.lit("f_price").alias("feature_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("event_time_us"), F.lit(0).alias("system_time_us"), F.col("o_orderkey").alias("sequence_no"), F.lit(UPSERT).alias("operation"), F.col("o_totalprice").alias("value"))
    return reads.latest(rows).select(F.col("entity_id").alias("c_custkey"), F.col("value").alias("last_price"))


@query("select event_id, epoch_us(ts) as micros from events")
def time_parse(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    return _t(spark, sf, "events").select("event_id", timeutil.column_micros(text).alias("micros"))


@query("select vec_id, len(embedding) as width, embedding[1] as first from embeddings")
def vector_parse(spark, sf):
    said = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]"))
    vector = literals.parse_vector(said, "float")
    return _t(spark, sf, "embeddings").select("vec_id", F.size(vector).alias("width"), vector[0].alias("first"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from duochron import store_queries  # noqa: F401  registers its own

    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _found.items() if s}
