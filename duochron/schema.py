"""The fact table, its keys, and the two expressions that every read shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = ["tenant_id", "entity_type", "entity_id"]
KEY = [*ENTITY, "feature_id"]
UPSERT, DELETE = "UPSERT", "DELETE"

#: The value types of the registry, and the field of the value struct that holds each.
VALUE_FIELDS = {"bool": "bool_value", "int64": "int64_value", "double": "double_value", "string": "string_value", "float_vector": "float_vector", "double_vector": "double_vector"}

_S, _L, _I, _B, _D, _F = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.FloatType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VALUE = _struct(value_type=_S, bool_value=_B, int64_value=_L, double_value=_D, string_value=_S, float_vector=T.ArrayType(_F), double_vector=T.ArrayType(_D))
QUALITY = _struct(is_corrected=_B, is_inferred=_B, is_stale=_B, source_validation_failed=_B, tags=T.ArrayType(_S))

EVENT_INPUT = _struct(batch_id=_S, arrival=_L, position=_I, tenant_id=_S, entity_type=_S, entity_id=_S, feature_id=_S, event_time_us=_L, system_time_us=_L, operation=_S, value=VALUE, write_id=_S, source_id=_S)
FEATURE_EVENT = _struct(tenant_id=_S, entity_type=_S, entity_id=_S, feature_id=_S, event_time_us=_L, system_time_us=_L, sequence_no=_L, lsn=_L, operation=_S, value=VALUE, write_id=_S, source_id=_S, quality_flags=QUALITY)
DRIVING = _struct(row_id=_S, tenant_id=_S, entity_type=_S, entity_id=_S, label_time_us=_L, system_cutoff_us=_L)


def version() -> Column:
    """The order of versions: event time, then system time, then sequence number; Spark compares structs field by field."""
    return F.struct("event_time_us", "system_time_us", "sequence_no")


def payload(events: DataFrame) -> Column:
    """Everything of an event but its key. A struct, so a null value and a tombstone stay apart through every selection."""
    return F.struct(*(c for c in events.columns if c not in KEY))


def live(operation: str = "operation") -> Column:
    """Whatever isn't a tombstone is an upsert."""
    return F.coalesce(F.col(operation) != DELETE, F.lit(True))


def typed(value_type: str, value: Column | None) -> Column:
    """A column as the tagged value struct; null keeps the tag."""
    fields = [F.lit(value_type).alias("value_type")]
    for field in VALUE.fields[1:]:
        held = value if value is not None and VALUE_FIELDS[value_type] == field.name else F.lit(None)
        fields.append(held.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def untyped(value: str, value_type: str) -> Column:
    """The field of a tagged value; raises in the plan if an event holds another type."""
    v = F.col(value)
    return F.when(v.isNull() | (v["value_type"] == value_type), v[VALUE_FIELDS[value_type]]).otherwise(F.raise_error(F.concat(F.lit(f"expected {value_type}, found "), v["value_type"])).cast("void"))
