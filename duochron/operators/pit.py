"""Point-in-time joins: for every driving row and feature, what was known then.

Strategies, all with one row per driving row and feature, found or not:

* ``shared``: one system cutoff for all rows. Events and driving rows of a slice of a timeline are sorted
  together by time and a running largest version answers every row; a slice begins with the largest version of
  the slices before it, from a partially aggregated table of slices. Linear, no join, and a hot timeline is
  as many tasks' work as it has slices.
* ``label``: the cutoff of every row is its label time. The same sweep, with an event at the later of its clocks.
* ``few``: few different cutoffs. The same sweep with the cutoff as part of the key; an event goes to every cutoff by which it was known.
* ``general``: any cutoffs. An equality join on the timeline with both comparisons, then a partially
  aggregated largest version; its work grows with rows times events of a timeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duochron.schema import ENTITY, KEY, live, payload, version

#: Up to so many different cutoffs, the sweep with the cutoff in its key is taken.
FEW = 16
#: Microseconds of a slice of a timeline.
SLICE = 86_400_000_000


def _asked(driving: DataFrame, features: list[str], default_cutoff_us: int | None) -> DataFrame:
    cutoff = F.col("system_cutoff_us") if "system_cutoff_us" in driving.columns else F.lit(None).cast("bigint")
    wide = driving.select("row_id", *ENTITY, "label_time_us", F.coalesce(cutoff, F.lit(default_cutoff_us).cast("bigint")).alias("cutoff_us"))
    return wide.withColumn("feature_id", F.explode(F.array(*(F.lit(f) for f in dict.fromkeys(features)))))


def _sweep(asked: DataFrame, events: DataFrame, at, cutoffs: list[int] | None = None) -> DataFrame:
    """Rows take the running largest version of their timeline. RANGE, so ties in time are visible; a row's own version is a null struct, which max_by passes over."""
    known = F.lit(None).cast("bigint") if cutoffs is None else F.explode(F.filter(F.array(*map(F.lit, cutoffs)).cast("array<bigint>"), lambda s: s >= F.col("system_time_us")))
    facts = events.select(*KEY, at.alias("_at"), version().alias("_v"), payload(events).alias("_p"), known.alias("cutoff_us"))
    kind, shape = facts.schema["_v"].dataType, facts.schema["_p"].dataType
    facts = facts.withColumns({"row_id": F.lit(None).cast(asked.schema["row_id"].dataType), "label_time_us": F.lit(None).cast("bigint"), "_asks": F.lit(False)})
    rows = asked.withColumns({"_at": F.col("label_time_us"), "_v": F.lit(None).cast(kind), "_p": F.lit(None).cast(shape), "_asks": F.lit(True)})
    key = [*KEY, *(["cutoff_us"] if cutoffs is not None else [])]
    slice_ = F.floor(F.col("_at") / SLICE).alias("_slice")
    ends = facts.select(*key, slice_, "_v", "_p").groupBy(*key, "_slice").agg(F.max("_v").alias("_v"), F.max_by("_p", "_v").alias("_p"))
    begun = rows.select(*key, slice_).distinct().select(*key, "_slice", F.lit(None).cast(kind).alias("_v"), F.lit(None).cast(shape).alias("_p"))
    before = Window.partitionBy(*key).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(begun).select(*key, "_slice", F.max("_v").over(before).alias("_v"), F.max_by("_p", "_v").over(before).alias("_p")).where("_v is not null").dropDuplicates([*key, "_slice"])
    carried = carried.select(*key, *([] if "cutoff_us" in key else [F.lit(None).cast("bigint").alias("cutoff_us")]), (F.col("_slice") * SLICE).alias("_at"), "_v", "_p").withColumns({"row_id": F.lit(None).cast(asked.schema["row_id"].dataType), "label_time_us": F.lit(None).cast("bigint"), "_asks": F.lit(False)})
    so_far = Window.partitionBy(*key, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = facts.unionByName(carried).unionByName(rows).withColumn("_slice", F.floor(F.col("_at") / SLICE))
    return every.withColumn("_w", F.max_by("_p", "_v").over(so_far)).where("_asks").select("row_id", *KEY, "label_time_us", "cutoff_us", "_w")


def _general(asked: DataFrame, events: DataFrame) -> DataFrame:
    facts = events.select(*KEY, F.col("event_time_us").alias("_e"), F.col("system_time_us").alias("_s"), version().alias("_v"), payload(events).alias("_p"))
    met = asked.join(facts, [*(asked[k] == facts[k] for k in KEY), F.col("_e") <= F.col("label_time_us"), F.col("_s") <= F.col("cutoff_us")], "left").select(*(asked[c] for c in ("row_id", *KEY, "label_time_us", "cutoff_us")), "_v", "_p")
    return met.groupBy("row_id", *KEY, "label_time_us", "cutoff_us").agg(F.max_by("_p", "_v").alias("_w"))


def choose(driving: DataFrame, default_cutoff_us: int | None = None) -> str:
    """The cheapest strategy that the cutoffs allow (one small aggregation over the driving rows)."""
    if "system_cutoff_us" not in driving.columns:
        return "shared"
    cutoff = F.coalesce("system_cutoff_us", F.lit(default_cutoff_us).cast("bigint"))
    same = driving.agg(F.coalesce(F.bool_and(cutoff.eqNullSafe(F.col("label_time_us"))), F.lit(False))).first()[0]
    some = driving.select(cutoff).distinct().limit(FEW + 1).count()
    return "label" if same else "shared" if some <= 1 else "few" if some <= FEW else "general"


def point_in_time(driving: DataFrame, events: DataFrame, features: list[str], default_cutoff_us: int | None = None, strategy: str | None = None) -> DataFrame:
    """``row_id, key, label_time_us, cutoff_us, found, value, event_time_us, system_time_us`` for every driving row and feature.

    Row ids are unique. A row without a cutoff of its own takes the default; one without either is rejected.
    """
    missing = driving.where(F.col("system_cutoff_us").isNull()) if "system_cutoff_us" in driving.columns else driving
    if default_cutoff_us is None and not missing.isEmpty():
        raise ValueError("a driving row has no system cutoff, and there is no default")
    strategy = strategy or choose(driving, default_cutoff_us)
    asked = _asked(driving, features, default_cutoff_us)
    mine = events.where(F.col("feature_id").isin(*features))
    if strategy == "label":
        won = _sweep(asked, mine, F.greatest("event_time_us", "system_time_us"))
    elif strategy in ("shared", "few"):
        cutoffs = [r[0] for r in asked.select("cutoff_us").distinct().limit(FEW + 1).collect()]
        if len(cutoffs) > (1 if strategy == "shared" else FEW):
            raise ValueError(f"{strategy}: too many different cutoffs")
        known = mine.where(F.col("system_time_us") <= max(cutoffs, default=0))
        won = _sweep(asked, known, F.col("event_time_us"), sorted(cutoffs) if len(cutoffs) > 1 else None)
    elif strategy == "general":
        won = _general(asked, mine)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    found = F.col("_w").isNotNull() & live("_w.operation")
    extra = [F.col(f"_w.{c}").alias(c) for c in ("quality_flags",) if c in events.columns]
    return won.select("row_id", *KEY, "label_time_us", "cutoff_us", found.alias("found"), F.when(found, F.col("_w.value")).alias("value"), F.when(found, F.col("_w.event_time_us")).alias("event_time_us"), F.when(found, F.col("_w.system_time_us")).alias("system_time_us"), *extra)


def wide(long: DataFrame, features: list[str]) -> DataFrame:
    """One row per driving row, one column per feature."""
    return long.groupBy("row_id", *ENTITY, "label_time_us", "cutoff_us").pivot("feature_id", list(dict.fromkeys(features))).agg(F.first("value"))


def with_defaults(long: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Values of features that weren't found (a found null stays null)."""
    value = F.col("value")
    for feature, default in defaults.items():
        value = F.when((F.col("feature_id") == feature) & ~F.col("found"), F.lit(default)).otherwise(value)
    return long.withColumn("value", value)


def complete_rows(long: DataFrame, features: list[str]) -> DataFrame:
    """The driving rows for which every feature was found."""
    n = len(set(features))
    whole = long.groupBy("row_id").agg(F.sum(F.col("found").cast("int")).alias("n")).where(F.col("n") == n).select("row_id")
    return long.join(whole, "row_id", "left_semi")


def group_features(members: DataFrame, tenant_id: str, group_id: str) -> list[str]:
    """The features of a group, in order; a group is a bounded registry row, not data."""
    return [r[0] for r in members.where((F.col("tenant_id") == tenant_id) & (F.col("group_id") == group_id)).select("feature_id").orderBy("feature_id").collect()]
