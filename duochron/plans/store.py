"""A table of facts in a folder: staged commits, laid-out parts behind a pointer, and maintenance.

``versions/v=<n>`` are the parts: facts in folders by tenant and feature (``_t``, ``_f``), sorted by entity
and version. ``staging`` holds a folder for every commit since the last checkpoint, which lays them out as one
more part; compaction makes one part of all. A pointer file names the parts, the commits and the registry's
file, and is replaced by a rename, so readers see one state or the next. One writer at a time holds the
lock file. Numbers of versions only grow.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duochron.operators import ingest
from duochron.plans.files import Files
from duochron.plans.registry import Registry
from duochron.schema import ENTITY, FEATURE_EVENT

_LAID_OUT = T.StructType([*FEATURE_EVENT.fields, T.StructField("v", T.LongType()), T.StructField("_t", T.StringType()), T.StructField("_f", T.StringType())])


class ReadOnly(RuntimeError):
    pass


class Locked(RuntimeError):
    pass


class Store:
    """``with Store(spark, root) as s``: opens or creates the folder and holds its lock. A part has a file for about so many rows."""

    def __init__(self, spark: SparkSession, root: str, backlog: int = 1000, rows_per_file: int = 1_000_000):
        self.spark, self.files, self.backlog, self.rows_per_file = spark, Files(spark), backlog, rows_per_file
        self.root = self.files.qualified(root)
        self.owner, self.read_only, self.open = uuid.uuid4().hex, False, False

    def __enter__(self) -> "Store":
        if not self.files.create(f"{self.root}/lock", self.owner):
            raise Locked(self.root)
        self.open = True
        if not self.files.exists(f"{self.root}/current"):
            self.state = {"version": 0, "parts": [], "commits": [], "lsn": 0, "sequence_no": 0, "checkpoint_lsn": 0, "next": 1, "registry": None}
            self.registry = Registry()
            self._save_registry()
        self.state = json.loads(self.files.read(f"{self.root}/current"))
        self.registry = Registry.from_json(self.files.read(f"{self.root}/{self.state['registry']}"))
        return self

    def __exit__(self, *_: object) -> None:
        self.open = False
        self.files.delete(f"{self.root}/lock")

    def _point(self) -> None:
        self.files.replace(f"{self.root}/current", json.dumps(self.state))

    def _write_registry(self) -> str:
        name = f"registry-{uuid.uuid4().hex}.json"
        self.files.replace(f"{self.root}/{name}", self.registry.to_json())
        return name

    def _save_registry(self) -> None:
        old, self.state["registry"] = self.state["registry"], self._write_registry()
        self._point()
        if old:
            self.files.delete(f"{self.root}/{old}")

    def _check(self, writes: bool = False) -> None:
        if not self.open:
            raise RuntimeError("the store isn't open")
        if writes and self.read_only:
            raise ReadOnly(self.root)

    def register(self, *features) -> None:
        self._check(True)
        for f in features:
            self.registry.create(f)
        self._save_registry()

    # reads

    def _part(self, version: int) -> str:
        return f"{self.root}/versions/v={version}"

    def base(self, tenant_id: str | None = None, feature_id: str | None = None) -> DataFrame:
        """The laid-out facts; a tenant and a feature choose folders before anything is read."""
        if not self.state["parts"]:
            return self.spark.createDataFrame([], FEATURE_EVENT)
        rows = self.spark.read.schema(_LAID_OUT).option("basePath", f"{self.root}/versions").parquet(*map(self._part, self.state["parts"]))
        for folder, wanted in (("_t", tenant_id), ("_f", feature_id)):
            if wanted is not None:
                rows = rows.where(F.col(folder) == wanted)
        return rows.select(*FEATURE_EVENT.names)

    def staged(self, tenant_id: str | None = None, feature_id: str | None = None) -> DataFrame:
        """What was committed since the last checkpoint (the ``memory`` source of a range read)."""
        if not self.state["commits"]:
            return self.spark.createDataFrame([], FEATURE_EVENT)
        rows = self.spark.read.schema(FEATURE_EVENT).parquet(*(f"{self.root}/staging/{c}" for c in self.state["commits"]))
        for name, wanted in (("tenant_id", tenant_id), ("feature_id", feature_id)):
            if wanted is not None:
                rows = rows.where(F.col(name) == wanted)
        return rows

    def events(self, source: str = "disk", tenant_id: str | None = None, feature_id: str | None = None) -> DataFrame:
        self._check()
        chosen = (tenant_id, feature_id)
        if source == "memory" or not self.state["parts"]:
            return self.staged(*chosen)
        return self.base(*chosen).unionByName(self.staged(*chosen)) if self.state["commits"] else self.base(*chosen)

    # writes

    def _scratch(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, events: DataFrame, trusted: bool = False, commit_us: int | None = None) -> DataFrame:
        """Write batches of EVENT_INPUT rows; ``batch_id, status, accepted_events, error`` of each.

        Status: ACCEPTED, DEDUPED (a write id was seen: nothing of the batch is written), or REJECTED.
        """
        self._check(True)
        try:
            checked = self._scratch(ingest.validated(events, self.registry.feature_table(self.spark), trusted))
            errors = self._scratch(ingest.batch_errors(checked))
            valid = checked.join(errors.where("error is null"), "batch_id", "left_semi").drop("error")
            won = ingest.admitted(valid, self.events(), self._scratch)
            accepted = valid.join(won, "batch_id", "left_semi")
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            facts = ingest.stamped(accepted, commit_us or time.time_ns() // 1000, self.state["lsn"], self.state["sequence_no"], n, self._scratch)
            commit = f"c{self.state['next']:012d}"
            facts.write.mode("overwrite").parquet(f"{self.root}/staging/{commit}")
            new = self.spark.read.schema(FEATURE_EVENT).parquet(f"{self.root}/staging/{commit}").agg(F.max("lsn"), F.max("sequence_no")).first()
            if new[0] is not None:
                self.state |= {"lsn": new[0], "sequence_no": new[1], "commits": [*self.state["commits"], commit]}
            self.state["next"] += 1
            self._point()
            sizes = accepted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted_events"))
            report = errors.join(sizes, "batch_id", "left").select("batch_id", F.when(F.col("error").isNotNull(), "REJECTED").when(F.col("accepted_events").isNull(), "DEDUPED").otherwise("ACCEPTED").alias("status"), F.coalesce("accepted_events", F.lit(0)).alias("accepted_events"), "error")
            path = f"{self.root}/reports/{commit}"
            report.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        finally:
            self.files.delete(f"{self.root}/scratch")

    # maintenance

    def _lay_out(self, events: DataFrame, version: int) -> bool:
        """Write a part, whose ranges of entity and time split large features and hot entities alike; False if there is nothing to write."""
        rows = events.count()
        if not rows:
            return False
        layout = events.withColumns({"_t": F.col("tenant_id"), "_f": F.col("feature_id")})
        ranged = layout.repartitionByRange(-(-rows // self.rows_per_file), "_t", "_f", *ENTITY[1:], "event_time_us")
        ranged.sortWithinPartitions("_t", "_f", *ENTITY[1:], F.desc("event_time_us"), F.desc("system_time_us"), F.desc("sequence_no")).write.partitionBy("_t", "_f").parquet(self._part(version))
        return True

    def _replace(self, parts: list[int], version: int) -> None:
        old = self.state
        self.state = old | {"version": max(parts, default=0), "parts": parts, "commits": [], "next": version + 1, "checkpoint_lsn": old["lsn"]}
        self._point()
        self._forget(old)

    def _forget(self, old: dict) -> None:
        for c in old["commits"]:
            self.files.delete(f"{self.root}/staging/{c}")
        for p in set(old["parts"]) - set(self.state["parts"]):
            self.files.delete(self._part(p))

    def checkpoint(self) -> dict:
        """Lay out staged commits as one more part, without touching the others; afterwards nothing is staged."""
        self._check()
        if self.state["commits"]:
            version = self.state["next"]
            new = [version] if self._lay_out(self.staged(), version) else []
            self._replace([*self.state["parts"], *new], version)
        return {"lsn": self.state["checkpoint_lsn"], "version": self.state["version"], "at_us": time.time_ns() // 1000}

    def compact(self, policy: str = "keep_all", amount: int = 0, now_us: int | None = None) -> None:
        """Rewrite all as one part without doubled write ids, keeping every revision and tombstone unless a retention policy is named."""
        self._check(True)
        kept = ingest.dedupe_events(self.events())
        version = self.state["next"]
        written = self._lay_out(ingest.retained(kept, policy, amount, now_us or time.time_ns() // 1000), version)
        self._replace([version] if written else [], version)

    def health(self) -> dict:
        self._check()
        segments = len(self.state["commits"]) + len(self.state["parts"])
        status = "READ_ONLY" if self.read_only else "COMPACTION_BACKLOG" if segments > self.backlog else "HEALTHY"
        return {"status": status, "lsn": self.state["lsn"], "version": self.state["version"], "segments": segments, "compactions_queued": max(0, segments - 1)}

    def stats(self) -> DataFrame:
        return self.events().groupBy("tenant_id", "feature_id").agg(F.count(F.lit(1)).alias("rows"), F.min("event_time_us").alias("min_event_time_us"), F.max("event_time_us").alias("max_event_time_us"), F.min("system_time_us").alias("min_system_time_us"), F.max("lsn").alias("max_lsn"))

    def backup(self, target: str) -> None:
        """A copy of the checkpointed state; the target is outside the store and appears whole or not at all."""
        self._check()
        target = self.files.qualified(target)
        if f"{target}/".startswith(f"{self.root}/") or f"{self.root}/".startswith(f"{target}/"):
            raise ValueError("the backup overlaps the store")
        if self.files.exists(target):
            raise ValueError("the backup's folder is there already")
        was, self.read_only = self.read_only, True
        try:
            self.checkpoint()
            beside = f"{target}.new"
            self.files.delete(beside)
            for p in self.state["parts"]:
                self.files.copy(self._part(p), f"{beside}/versions/v={p}")
            for name in (self.state["registry"], "current"):
                self.files.copy(f"{self.root}/{name}", f"{beside}/{name}")
            self.files.move(beside, target)
        finally:
            self.read_only = was

    def restore(self, source: str, read_only: bool = False) -> None:
        """Replace the state by a backup's. The copy is made under new version numbers and checked before the pointer moves, which names the registry's file too, so a failure keeps the old state whole."""
        self._check()
        source = self.files.qualified(source)
        there = json.loads(self.files.read(f"{source}/current"))
        registry = Registry.from_json(self.files.read(f"{source}/{there['registry']}"))
        first = max(self.state["next"], there["next"])
        parts = list(range(first, first + len(there["parts"])))
        try:
            for old_part, new_part in zip(there["parts"], parts, strict=True):
                self.files.copy(f"{source}/versions/v={old_part}", self._part(new_part))
                self.spark.read.schema(FEATURE_EVENT).parquet(self._part(new_part)).agg(F.max("lsn")).collect()
        except Exception:
            for p in parts:
                self.files.delete(self._part(p))
            raise
        old, self.registry = self.state, registry
        self.state = there | {"version": max(parts, default=0), "parts": parts, "commits": [], "next": first + len(parts) + 1, "registry": self._write_registry()}
        self._point()
        self._forget(old)
        self.files.delete(f"{self.root}/{old['registry']}")
        self.read_only = read_only
