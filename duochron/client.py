"""A facade for one entity: upsert, delete, latest, get and range over a store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duochron.functions.timeutil import to_micros, to_range
from duochron.operators import reads
from duochron.plans.registry import Feature, NotFound
from duochron.plans.store import Store
from duochron.schema import DELETE, EVENT_INPUT, UPSERT, VALUE_FIELDS


class Client:
    def __init__(self, store: Store):
        self.store = store

    def register(self, tenant_id: str, feature_id: str, value_type: str, entity_type: str = "entity") -> None:
        self.store.register(Feature(tenant_id, feature_id, feature_id, entity_type, value_type))

    def entity(self, tenant_id: str, entity_id: str, entity_type: str = "entity") -> "EntityClient":
        return EntityClient(self.store, tenant_id, entity_id, entity_type)


class EntityClient:
    def __init__(self, store: Store, tenant_id: str, entity_id: str, entity_type: str):
        self.store, self.key = store, {"tenant_id": tenant_id, "entity_type": entity_type, "entity_id": entity_id}

    def _write(self, feature_id: str, event_time, operation: str, value, write_id: str | None) -> int:
        kind = self.store.registry.get(self.key["tenant_id"], feature_id).value_type
        write_id = write_id or f"py-{operation.lower()}-{uuid.uuid4()}"
        held = {"value_type": kind} | {f: None for f in VALUE_FIELDS.values()} | ({VALUE_FIELDS[kind]: value} if value is not None else {})
        row = {"batch_id": write_id, "arrival": 0, "position": 0, **self.key, "feature_id": feature_id, "event_time_us": to_micros(event_time), "system_time_us": None, "operation": operation, "value": held, "write_id": write_id, "source_id": "client"}
        done = self.store.write(self.store.spark.createDataFrame([row], EVENT_INPUT)).first()
        if done.status == "REJECTED":
            raise ValueError(done.error)
        return done.accepted_events

    def upsert(self, feature_id: str, event_time, value, write_id: str | None = None) -> int:
        return self._write(feature_id, event_time, UPSERT, value, write_id)

    def delete(self, feature_id: str, event_time, write_id: str | None = None) -> int:
        return self._write(feature_id, event_time, DELETE, None, write_id)

    def _own(self, feature_id: str | None = None, source: str = "disk"):
        mine = reads.of_entity(self.store.events(source, self.key["tenant_id"], feature_id), **self.key)
        return mine if feature_id is None else mine.where(F.col("feature_id") == feature_id)

    @staticmethod
    def _plain(row):
        return row.value[VALUE_FIELDS[row.value.value_type]] if row.value is not None else None

    def latest(self, feature_id: str, count: int = 1):
        """The newest value (None if missing), or with a count the list of the newest."""
        if count < 1:
            raise ValueError("the count must be at least 1")
        if count > 1:
            return [self._plain(r) for r in reads.latest_n(self._own(feature_id), count).orderBy("rank").collect()]
        if self._own().isEmpty():
            raise NotFound(self.key["entity_id"])
        row = reads.latest(self._own(feature_id)).first()
        return self._plain(row) if row and row.found else None

    def latest_as(self, feature_id: str, value_type: str):
        if self.store.registry.get(self.key["tenant_id"], feature_id).value_type != value_type:
            raise TypeError(f"{feature_id} isn't {value_type}")
        return self.latest(feature_id)

    def get(self) -> dict[str, tuple[bool, object]]:
        """(found, value) of every registered feature."""
        answers = {r.feature_id: r for r in reads.latest(self._own()).collect()}
        return {f.feature_id: (True, self._plain(answers[f.feature_id])) if f.feature_id in answers and answers[f.feature_id].found else (False, None) for f in self.store.registry.list(self.key["tenant_id"], self.key["entity_type"])}

    def get_range(self, feature_id: str, bounds, disk: bool = True) -> list:
        furthest, latest = to_range(bounds)
        return [self._plain(r) for r in reads.newest_first(reads.range_events(self._own(feature_id, "disk" if disk else "memory"), furthest, latest)).collect()]

    def as_of(self, feature_id: str, event_time, system_time):
        row = reads.as_of(self._own(feature_id), to_micros(event_time), to_micros(system_time)).first()
        return self._plain(row) if row and row.found else None
