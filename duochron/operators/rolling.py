"""Rolling aggregates over the visible revision of each event time, and features derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duochron.operators.reads import revisions
from duochron.schema import DELETE, ENTITY, KEY

#: The aggregate names, by function.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _sliced(rows: DataFrame, width_us: int) -> DataFrame:
    """Every row in its slice of a timeline and, as what lies before others, in the next: a window of the width never reaches further, so a hot timeline is many tasks' work."""
    own = F.floor(F.col("event_time_us") / width_us)
    return rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))


def _span(width_us: int) -> Window:
    return Window.partitionBy(*KEY, "_slice").orderBy("event_time_us").rangeBetween(-(width_us - 1), Window.currentRow)


def rolling(events: DataFrame, width_us: int, system_time_us: int, aggregates: list[str], value: str = "value") -> DataFrame:
    """At every visible event time T, aggregates over T - width < event_time <= T. Nulls contribute to no aggregate; tombstoned events aren't there."""
    over = {f"rolling_{a}": AGGREGATES[a](value).over(_span(width_us)) for a in aggregates}
    return _sliced(revisions(events, system_time_us), width_us).withColumns(over).where("_slice = _own").drop("_slice", "_own")


def rolling_at(driving: DataFrame, events: DataFrame, width_us: int, aggregates: list[str], value: str = "value") -> DataFrame:
    """The same for driving rows with their own label times and cutoffs: a join on the timeline and the window's slices, then two aggregations.

    Events and rows meet in slices of the window's width, so a row meets the events of two slices and not the whole timeline.
    """
    facts = events.withColumn("_slice", F.floor(F.col("event_time_us") / width_us)).select(*ENTITY, "feature_id", "_slice", "event_time_us", "system_time_us", "sequence_no", "operation", F.col(value).alias("_value"))
    here = F.floor(F.col("label_time_us") / width_us)
    rows = driving.select("row_id", *ENTITY, "label_time_us", "system_cutoff_us", F.explode(F.array(here - 1, here)).alias("_slice"))
    met = rows.join(facts, [*ENTITY, "_slice"]).where((F.col("event_time_us") > F.col("label_time_us") - width_us) & (F.col("event_time_us") <= F.col("label_time_us")) & (F.col("system_time_us") <= F.col("system_cutoff_us")))
    known = met.groupBy("row_id", *KEY, "event_time_us").agg(F.max_by(F.struct("operation", "_value"), F.struct("system_time_us", "sequence_no")).alias("_w")).where(F.coalesce(F.col("_w.operation") != DELETE, F.lit(True)))
    return known.groupBy("row_id", *KEY).agg(*(AGGREGATES[a]("_w._value").alias(f"rolling_{a}") for a in aggregates))


def rolling_last_n(events: DataFrame, n: int, system_time_us: int, value: str = "value") -> DataFrame:
    """The mean of the last n visible events at every visible event time."""
    if n < 1:
        raise ValueError("the number of events must be at least 1")
    span = Window.partitionBy(*KEY).orderBy("event_time_us").rowsBetween(-(n - 1), Window.currentRow)
    return revisions(events, system_time_us).withColumns({"last_n_mean": F.avg(value).over(span), "last_n_count": F.count(value).over(span)})


def z_score(events: DataFrame, width_us: int, system_time_us: int, value: str = "value") -> DataFrame:
    """How many standard deviations an event is from its window's mean; null where the window has no spread."""
    mean, spread = F.avg(value).over(_span(width_us)), F.stddev_pop(value).over(_span(width_us))
    scored = _sliced(revisions(events, system_time_us), width_us).withColumn("z_score", F.when(spread > 0, (F.col(value) - mean) / spread))
    return scored.where("_slice = _own").drop("_slice", "_own")


def ratio(latest: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """The quotient of two features of each entity; null where either is missing or the second is zero. One pass, no join."""
    own = lambda f: F.max(F.when((F.col("feature_id") == f) & F.col("found"), F.col("value")))
    both = latest.where(F.col("feature_id").isin(numerator, denominator)).groupBy(*ENTITY).agg(own(numerator).alias("n"), own(denominator).alias("d"))
    return both.select(*ENTITY, F.when(F.col("d") != 0, F.col("n") / F.col("d")).alias("ratio"))
