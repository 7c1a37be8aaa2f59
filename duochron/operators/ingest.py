"""Writes: validation, idempotency and stamping of event batches, as DataFrame transformations.

A batch (``batch_id``) is atomic. ``arrival`` orders batches, ``position`` the events of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duochron.schema import DELETE, FEATURE_EVENT, KEY, VALUE_FIELDS

#: What can be wrong with an event, in the order in which it is looked for.
ERRORS = ("INVALID_ENTITY", "INVALID_FEATURE_ID", "INVALID_EVENT_TIME", "INVALID_WRITE_ID", "SYSTEM_TIME_NOT_TRUSTED", "FEATURE_NOT_FOUND", "ENTITY_TYPE_MISMATCH", "SYSTEM_TIME_DENIED", "NULL_NOT_ALLOWED", "VALUE_TYPE_MISMATCH")


def _empty(name: str):
    return F.col(name).isNull() | (F.col(name) == "")


def validated(events: DataFrame, features: DataFrame, trusted: bool = False) -> DataFrame:
    """Adds ``error``: the first thing wrong with each event, or null. ``features`` is the registry table, which is small by nature; it is broadcast only by Spark's own size check."""
    known = features.select("tenant_id", "feature_id", F.col("entity_type").alias("_type"), F.col("value_type").alias("_kind"), F.col("nullable").alias("_nullable"), F.col("allow_external_system_time").alias("_external"))
    held = F.lit(None).cast("boolean")
    for kind, name in VALUE_FIELDS.items():
        held = F.when(F.col("_kind") == kind, F.col(f"value.{name}").isNotNull()).otherwise(held)
    others = F.lit(False)
    for kind, name in VALUE_FIELDS.items():
        others = others | ((F.col("_kind") != kind) & F.col(f"value.{name}").isNotNull())
    upsert = F.coalesce(F.col("operation") != DELETE, F.lit(True))
    none = ~F.coalesce(held, F.lit(False))
    checks = (
        _empty("tenant_id") | _empty("entity_type") | _empty("entity_id"), _empty("feature_id"), F.coalesce(F.col("event_time_us"), F.lit(0)) <= 0, _empty("write_id"),
        F.col("system_time_us").isNotNull() & F.lit(not trusted), F.col("_kind").isNull(), F.col("_type") != F.col("entity_type"), F.col("system_time_us").isNotNull() & ~F.col("_external"),
        upsert & none & ~F.coalesce(others, F.lit(False)) & ~F.col("_nullable"), upsert & F.coalesce(others, F.lit(False)),
    )
    error = F.lit(None).cast("string")
    for name, check in reversed(list(zip(ERRORS, checks, strict=True))):
        error = F.when(check, name).otherwise(error)
    return events.join(known, ["tenant_id", "feature_id"], "left").withColumn("error", error).drop("_type", "_kind", "_nullable", "_external")


def batch_errors(checked: DataFrame) -> DataFrame:
    """``batch_id, error``: the first failing event's error, or DUPLICATE_WRITE_ID for a write id twice in a batch, or null."""
    first = checked.groupBy("batch_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("position", "error"))).alias("e"))
    twice = checked.groupBy("batch_id", "write_id").agg(F.count(F.lit(1)).alias("n")).groupBy("batch_id").agg(F.max("n").alias("n"))
    return first.join(twice, "batch_id").select("batch_id", F.coalesce(F.col("e.error"), F.when(F.col("n") > 1, "DUPLICATE_WRITE_ID")).alias("error"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Of events with one write id, that with the smallest lsn and sequence number."""
    rest = [c for c in events.columns if c != "write_id"]
    return events.groupBy("write_id").agg(F.min_by(F.struct(*rest), F.struct("lsn", "sequence_no")).alias("_w")).select("write_id", "_w.*").select(*events.columns)


#: Bytes of a load's write ids up to which they are sent to all tasks that read the history.
SENT_BYTES = 32 << 20


def seen_ids(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """The write ids of a load (``ids``, written down) that the history holds. A load of a measured size goes to the history, which then isn't shuffled."""
    size = ids.agg(F.coalesce(F.sum(F.octet_length("write_id") + 32), F.lit(0))).first()[0]
    wanted = ids.select("write_id")
    return seen.select("write_id").join(F.broadcast(wanted) if size <= SENT_BYTES else wanted, "write_id", "left_semi").distinct()


def admitted(batches: DataFrame, seen: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``batch_id`` of the batches that a writer would accept one after another by arrival.

    A batch is dropped if any of its write ids is in ``seen`` or in an *accepted* earlier batch. Each
    round accepts the batches that are the earliest undecided one for all their ids and drops those that
    share an id with an accepted one; a load without shared ids takes one round. ``staged`` writes a
    DataFrame down and returns it.
    """
    ids = staged(batches.select("batch_id", "arrival", "write_id").distinct())
    stale = ids.join(seen_ids(ids, seen), "write_id", "left_semi").select("batch_id").distinct()
    open_ids = staged(ids.join(stale, "batch_id", "left_anti"))
    won = None
    while True:
        least = open_ids.groupBy("write_id").agg(F.min(F.struct("arrival", "batch_id")).alias("least"))
        first = open_ids.join(least, "write_id").groupBy("batch_id").agg(F.bool_and(F.col("least.batch_id") == F.col("batch_id")).alias("ok")).where("ok").select("batch_id")
        now = staged(first)
        won = now if won is None else won.unionByName(now)
        taken = open_ids.join(now, "batch_id", "left_semi").select("write_id").distinct()
        lost = open_ids.join(taken, "write_id", "left_semi").select("batch_id").distinct()
        open_ids = staged(open_ids.join(lost, "batch_id", "left_anti"))
        if open_ids.isEmpty():
            return won


def numbered(rows: DataFrame, order: list[str], partitions: int, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``index`` from 0 in a total order, without a window over all rows: ranges, places inside each, and the ranges' starts."""
    placed = staged(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn("index", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def stamped(events: DataFrame, commit_us: int, lsn: int, sequence_no: int, partitions: int, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Accepted events as facts: system time, one lsn per batch by arrival, and sequence numbers by arrival and position."""
    batch = numbered(events.groupBy("batch_id").agg(F.min("arrival").alias("arrival")), ["arrival", "batch_id"], partitions, staged).select("batch_id", (F.col("index") + lsn + 1).alias("lsn"))
    every = numbered(events, ["arrival", "batch_id", "position"], partitions, staged).join(batch, "batch_id")
    flags = F.col("quality_flags") if "quality_flags" in events.columns else F.lit(None).cast(FEATURE_EVENT["quality_flags"].dataType)
    return every.select(*KEY, "event_time_us", F.coalesce("system_time_us", F.lit(commit_us)).alias("system_time_us"), (F.col("index") + sequence_no + 1).alias("sequence_no"), "lsn", "operation", F.col("value").cast(FEATURE_EVENT["value"].dataType).alias("value"), "write_id", "source_id", flags.alias("quality_flags"))


def retained(events: DataFrame, policy: str, amount: int = 0, now_us: int = 0) -> DataFrame:
    """``keep_all``; ``days``: event times of the last so many days; ``last_k``: the k newest versions of a timeline; ``latest_after``: beyond so many days only the winner. Tombstones stay."""
    if policy == "keep_all":
        return events
    dead = F.col("operation") == DELETE
    recent = F.col("event_time_us") > now_us - amount * 86_400_000_000
    newest = Window.partitionBy(*KEY).orderBy(F.desc("event_time_us"), F.desc("system_time_us"), F.desc("sequence_no"))
    ranked = events.withColumn("_rank", F.row_number().over(newest))
    if policy == "days":
        return events.where(recent | dead)
    if policy == "last_k":
        return ranked.where((F.col("_rank") <= amount) | dead).drop("_rank")
    if policy == "latest_after":
        return ranked.where(recent | dead | (F.col("_rank") == 1)).drop("_rank")
    raise ValueError(f"unknown policy {policy!r}")
