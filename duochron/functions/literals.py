"""Literals, tags and identifiers. Parsing is strict: a number must be the whole literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duochron.schema import typed


def parse_vector(text: Column, element: str = "double") -> Column:
    """'[1, 2.5]' or '1,2.5' as an array; empty brackets give an empty array, an empty or bad element gives null."""
    inner = F.trim(F.regexp_replace(F.trim(text), r"^\[|\]$", ""))
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    whole = F.when(inner == "", F.array().cast("array<double>")).when(F.forall(parts, lambda x: x.isNotNull()), parts)
    return whole.cast(f"array<{element}>")


def parse_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def parse_value(text: Column, value_type: str) -> Column:
    """A text literal as a tagged value; its field is null where the literal doesn't fit the type."""
    held = {"bool": lambda: parse_bool(text), "int64": lambda: text.try_cast("bigint"), "double": lambda: text.try_cast("double"), "string": lambda: text, "float_vector": lambda: parse_vector(text, "float"), "double_vector": lambda: parse_vector(text)}
    if value_type not in held:
        raise ValueError(f"unknown value type {value_type!r}")
    return typed(value_type, held[value_type]())


def literal_of(value: bool | int | float | str | list) -> str:
    """A Python value as a literal; None and other types are TypeErrors."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, str)):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value):
        return "[" + ",".join(repr(float(x)) for x in value) + "]"
    raise TypeError(f"no literal for {type(value).__name__}")


def value_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "true"})


def base64_json(value: Column) -> Column:
    return F.base64(value_json(value).cast("binary"))


def tags_to_text(tags: Column) -> Column:
    return F.array_join(tags, ",")


def tags_from_text(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def content_write_id(*columns: str) -> Column:
    """A write id that a replay of the same row repeats."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def checksum(data: Column) -> Column:
    return F.crc32(data)
