"""Reads as SQL table functions, which Catalyst inlines like views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from duochron.schema import DELETE, KEY


def register(spark: SparkSession, view: str) -> None:
    """``feature_as_of(event_time_us, system_time_us)`` and ``feature_latest()`` over a temporary view of facts."""
    kind = spark.table(view).schema["value"].dataType.simpleString()
    keys = ", ".join(KEY)
    columns = f"{', '.join(f'{k} STRING' for k in KEY)}, found BOOLEAN, value {kind}, event_time_us BIGINT, system_time_us BIGINT"
    won = "max_by(struct(operation, value, event_time_us, system_time_us), struct(event_time_us, system_time_us, sequence_no)) AS w"
    seen = f"coalesce(w.operation <> '{DELETE}', true)"
    for name, given, where in (("feature_as_of", "e BIGINT, s BIGINT", "WHERE event_time_us <= e AND system_time_us <= s"), ("feature_latest", "", "")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({columns}) RETURN SELECT {keys}, {seen} AS found, CASE WHEN {seen} THEN w.value END AS value, w.event_time_us, w.system_time_us FROM (SELECT {keys}, {won} FROM {view} {where} GROUP BY {keys})")
