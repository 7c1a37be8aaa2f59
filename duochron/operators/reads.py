"""Reads of the fact table. All are lazy; cutoffs are inclusive; ``events`` may hold any value column.

The winner of a timeline is the largest version. It is found with max_by over structs, which Spark
aggregates before it shuffles, so a hot key costs one row per task. A tombstone is judged after the
selection: a winner that is one means *missing*, and a null value is *found*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duochron.schema import ENTITY, KEY, live, version


def visible(event_time_us, system_time_us) -> Column:
    """event_time <= E and system_time <= S; numbers or columns. Plain comparisons, so Parquet statistics prune."""
    e, s = (x if isinstance(x, Column) else F.lit(x) for x in (event_time_us, system_time_us))
    return (F.col("event_time_us") <= e) & (F.col("system_time_us") <= s)


def of_entity(events: DataFrame, tenant_id: str, entity_type: str, entity_id: str) -> DataFrame:
    return events.where((F.col("tenant_id") == tenant_id) & (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))


def winners(events: DataFrame, *more: str) -> DataFrame:
    """The largest version of every timeline (and of every value of ``more``), tombstones included."""
    keys = [*KEY, *more]
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), version() if "event_time_us" in rest else F.struct("system_time_us", "sequence_no")).alias("_w")).select(*keys, "_w.*")


def as_found(selected: DataFrame) -> DataFrame:
    """Winners as answers: ``found``, and the value only where it is."""
    seen = live()
    return selected.withColumn("found", seen).withColumn("value", F.when(seen, F.col("value")))


def latest(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The newest event of every timeline by event time, whenever it became known.

    ``columns`` are what is wanted besides the key, the clocks and the operation. The selection carries
    whole rows, which Catalyst can't prune afterwards, so naming them keeps the rest unread.
    """
    if columns is not None:
        events = events.select(*dict.fromkeys([*KEY, "event_time_us", "system_time_us", "sequence_no", "operation", "value", *columns]))
    return as_found(winners(events))


def as_of(events: DataFrame, event_time_us: int, system_time_us: int, columns: list[str] | None = None) -> DataFrame:
    """What was known at system_time about event_time."""
    return latest(events.where(visible(event_time_us, system_time_us)), columns)


def requested(spark: SparkSession, answers: DataFrame, entity: dict[str, str], features: list[str]) -> DataFrame:
    """Answers in the order of a request, repeats kept; a feature without an answer isn't found. One row per request position."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, features))).alias("position", "feature_id"))
    own = of_entity(answers, **entity)
    return asked.join(own, "feature_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("position")


def latest_n(events: DataFrame, n: int) -> DataFrame:
    """The n newest upserts of every timeline, superseded ones included, with ``rank``; none if the newest event is a tombstone."""
    if n < 1:
        raise ValueError("the limit must be at least 1")
    gone = winners(events.select(*KEY, "event_time_us", "system_time_us", "sequence_no", "operation")).where(~live()).select(*KEY)
    newest = Window.partitionBy(*KEY).orderBy(F.desc("event_time_us"), F.desc("system_time_us"), F.desc("sequence_no"))
    # the rank's limit is pushed below the shuffle
    return events.where(live()).join(gone, KEY, "left_anti").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def range_events(events: DataFrame, furthest_us: int, latest_us: int | None = None) -> DataFrame:
    """All upserts, revisions included, with an event time in the closed range; a tombstone hides only itself."""
    if latest_us is not None and latest_us < furthest_us:
        raise ValueError("the latest time is before the furthest")
    found = events.where(live() & (F.col("event_time_us") >= furthest_us))
    return found if latest_us is None else found.where(F.col("event_time_us") <= latest_us)


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("event_time_us"), F.desc("system_time_us"), F.desc("sequence_no"))


def entity_snapshot(events: DataFrame, features: DataFrame, entities: DataFrame, entity_type: str = "entity") -> DataFrame:
    """Every registered feature of every entity; features without an event, and entities without any, aren't found."""
    wanted = features.where(F.col("entity_type") == entity_type).select("tenant_id", "entity_type", "feature_id")
    grid = entities.select(*ENTITY).distinct().join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, ["tenant_id", "entity_type"])
    return grid.join(latest(events), KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def revisions(events: DataFrame, system_time_us: int | None = None) -> DataFrame:
    """One visible revision per event time: the last known of it; tombstoned event times are dropped."""
    seen = events if system_time_us is None else events.where(F.col("system_time_us") <= system_time_us)
    return winners(seen, "event_time_us").where(live())


def window_scan(events: DataFrame, start_us: int, end_us: int, system_time_us: int) -> DataFrame:
    """The visible revisions with an event time in the closed interval."""
    return revisions(events.where(F.col("event_time_us").between(start_us, end_us)), system_time_us)


def audit_history(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """All revisions in the closed interval, tombstones included, each with the write that replaced it at its event time."""
    known = Window.partitionBy(*KEY, "event_time_us").orderBy("system_time_us", "sequence_no")
    return events.where(F.col("event_time_us").between(start_us, end_us)).withColumn("replaced_by", F.lead("write_id").over(known))


def visible_commit(events: DataFrame) -> DataFrame:
    """Per entity, the largest lsn and system time of its newest events, tombstones included."""
    return winners(events).groupBy(*ENTITY).agg(F.max("lsn").alias("lsn"), F.max("system_time_us").alias("system_time_us"))


def at_least(events: DataFrame, lsn: int) -> DataFrame:
    """The events, if ``lsn`` has been applied; raises ValueError if it hasn't (a read fence, not a filter)."""
    applied = events.agg(F.max("lsn")).first()[0]
    if applied is None or applied < lsn:
        raise ValueError(f"lsn {lsn} isn't visible yet; {applied} is")
    return events


def with_freshness(answers: DataFrame, now_us: int, bound_us: int) -> DataFrame:
    """``is_stale``: a found value whose event time is older than the bound."""
    return answers.withColumn("is_stale", F.col("found") & (F.lit(now_us) - F.col("event_time_us") > bound_us))


def correction_report(events: DataFrame) -> DataFrame:
    """Per timeline, its event times, its revisions beyond the first of each, and its tombstones."""
    per = events.groupBy(*KEY, "event_time_us").agg(F.count(F.lit(1)).alias("n"), F.sum((~live()).cast("bigint")).alias("d"))
    return per.groupBy(*KEY).agg(F.count(F.lit(1)).alias("event_times"), F.sum(F.col("n") - 1).alias("corrections"), F.sum("d").alias("tombstones"))
