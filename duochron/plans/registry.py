"""Feature definitions and groups: a small table that the driver holds and checks before each change."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from duochron.schema import VALUE_FIELDS


class AlreadyExists(ValueError):
    pass


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class Feature:
    tenant_id: str
    feature_id: str
    feature_name: str
    entity_type: str
    value_type: str
    description: str = ""
    owner: str = ""
    nullable: bool = True
    serving_enabled: bool = True
    historical_enabled: bool = True
    allow_external_system_time: bool = True
    freshness_sla: int = 0
    retention_policy_id: str = ""
    tags: tuple[str, ...] = ()
    created_at_us: int = 0
    updated_at_us: int = 0


@dataclass(frozen=True)
class Group:
    tenant_id: str
    group_id: str
    group_name: str
    entity_type: str
    features: tuple[str, ...] = ()
    description: str = ""
    created_at_us: int = 0
    updated_at_us: int = 0


FEATURE_DDL = "tenant_id string, feature_id string, feature_name string, entity_type string, value_type string, description string, owner string, nullable boolean, serving_enabled boolean, historical_enabled boolean, allow_external_system_time boolean, freshness_sla bigint, retention_policy_id string, tags array<string>, created_at_us bigint, updated_at_us bigint"
#: What an update may change; other attributes of the given definition are passed over.
MUTABLE = ("description", "owner", "nullable", "serving_enabled", "historical_enabled", "allow_external_system_time", "freshness_sla", "retention_policy_id", "tags")


@dataclass
class Registry:
    features: dict[tuple[str, str], Feature] = field(default_factory=dict)
    groups: dict[tuple[str, str], Group] = field(default_factory=dict)
    schema_version: int = 1

    def create(self, feature: Feature) -> Feature:
        for name in ("tenant_id", "feature_id", "feature_name", "entity_type"):
            if not getattr(feature, name):
                raise ValueError(f"{name} is empty")
        if feature.value_type not in VALUE_FIELDS:
            raise ValueError(f"unknown value type {feature.value_type!r}")
        if (feature.tenant_id, feature.feature_id) in self.features:
            raise AlreadyExists(feature.feature_id)
        if any((f.tenant_id, f.entity_type, f.feature_name) == (feature.tenant_id, feature.entity_type, feature.feature_name) for f in self.features.values()):
            raise AlreadyExists(feature.feature_name)
        now = time.time_ns() // 1000
        self.features[feature.tenant_id, feature.feature_id] = made = replace(feature, created_at_us=feature.created_at_us or now, updated_at_us=now)
        return made

    def update(self, feature: Feature) -> Feature:
        old = self.get(feature.tenant_id, feature.feature_id)
        self.features[old.tenant_id, old.feature_id] = made = replace(old, **{k: getattr(feature, k) for k in MUTABLE}, updated_at_us=time.time_ns() // 1000)
        return made

    def get(self, tenant_id: str, feature_id: str) -> Feature:
        try:
            return self.features[tenant_id, feature_id]
        except KeyError:
            raise NotFound(feature_id) from None

    def by_name(self, tenant_id: str, entity_type: str, name: str) -> Feature:
        for f in self.features.values():
            if (f.tenant_id, f.entity_type, f.feature_name) == (tenant_id, entity_type, name):
                return f
        raise NotFound(name)

    def list(self, tenant_id: str, entity_type: str | None = None) -> list[Feature]:
        return sorted((f for f in self.features.values() if f.tenant_id == tenant_id and entity_type in (None, f.entity_type)), key=lambda f: (f.entity_type, f.feature_name))

    def create_group(self, group: Group) -> Group:
        for name in ("tenant_id", "group_id", "group_name", "entity_type"):
            if not getattr(group, name):
                raise ValueError(f"{name} is empty")
        if (group.tenant_id, group.group_id) in self.groups or any((g.tenant_id, g.entity_type, g.group_name) == (group.tenant_id, group.entity_type, group.group_name) for g in self.groups.values()):
            raise AlreadyExists(group.group_id)
        for feature_id in group.features:
            if self.get(group.tenant_id, feature_id).entity_type != group.entity_type:
                raise ValueError(f"{feature_id} is of another entity type")
        now = time.time_ns() // 1000
        self.groups[group.tenant_id, group.group_id] = made = replace(group, features=tuple(sorted(set(group.features))), created_at_us=now, updated_at_us=now)
        return made

    def get_group(self, tenant_id: str, group_id: str) -> Group:
        try:
            return self.groups[tenant_id, group_id]
        except KeyError:
            raise NotFound(group_id) from None

    def feature_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*(getattr(f, k.split()[0]) if k.split()[0] != "tags" else list(f.tags) for k in FEATURE_DDL.split(", ")),) for f in self.features.values()], FEATURE_DDL)

    def member_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g.tenant_id, g.group_id, f) for g in self.groups.values() for f in g.features], "tenant_id string, group_id string, feature_id string")

    def to_json(self) -> str:
        return json.dumps({"schema_version": self.schema_version, "features": [asdict(f) for f in self.features.values()], "groups": [asdict(g) for g in self.groups.values()]})

    @classmethod
    def from_json(cls, text: str) -> "Registry":
        said = json.loads(text)
        made = cls(schema_version=said["schema_version"])
        for f in said["features"]:
            made.features[f["tenant_id"], f["feature_id"]] = Feature(**f | {"tags": tuple(f["tags"])})
        for g in said["groups"]:
            made.groups[g["tenant_id"], g["group_id"]] = Group(**g | {"features": tuple(g["features"])})
        return made
