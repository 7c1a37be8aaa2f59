"""File sources and sinks. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duochron.functions.literals import parse_value
from duochron.functions.timeutil import column_micros
from duochron.schema import DRIVING, EVENT_INPUT, UPSERT, typed


def _input(rows: DataFrame, tenant_id: str, entity_type: str, feature_id: str, value, source_id: str) -> DataFrame:
    """Single-event batches in write_id order."""
    known = F.col("system_time_us") if "system_time_us" in rows.columns else F.lit(None).cast("bigint")
    return rows.select(
        F.col("write_id").alias("batch_id"), F.lit(0).cast("bigint").alias("arrival"), F.lit(0).alias("position"), F.lit(tenant_id).alias("tenant_id"), F.lit(entity_type).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"),
        F.lit(feature_id).alias("feature_id"), "event_time_us", known.alias("system_time_us"), F.lit(UPSERT).alias("operation"), value.alias("value"), "write_id", F.lit(source_id).alias("source_id"),
    ).to(EVENT_INPUT)


def csv_events(spark: SparkSession, path: str, tenant_id: str, entity_type: str, feature_id: str, value_type: str = "double", source_id: str = "csv") -> DataFrame:
    """entity_id, event_time_us, value, write_id and perhaps system_time_us, with a header; a malformed row fails the read."""
    names = spark.read.option("header", True).csv(path).columns
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("mode", "FAILFAST").csv(path)
    times = {c: column_micros(c) for c in ("event_time_us", "system_time_us") if c in names}
    return _input(rows.withColumns(times), tenant_id, entity_type, feature_id, parse_value(F.col("value"), value_type), source_id)


def parquet_events(spark: SparkSession, path: str, tenant_id: str, entity_type: str, feature_id: str, value_type: str = "double", source_id: str = "parquet") -> DataFrame:
    rows = spark.read.parquet(path)
    return _input(rows, tenant_id, entity_type, feature_id, typed(value_type, F.col("value")), source_id)


def arrow_events(spark: SparkSession, path: str, tenant_id: str, entity_type: str, feature_id: str, value_type: str = "double", source_id: str = "arrow") -> DataFrame:
    """Arrow files or streams of a folder or name pattern, each read whole by one task."""
    import pyarrow as pa

    def tables(batches):
        for b in batches:
            for content in b.column("content"):
                data = pa.BufferReader(content.as_buffer())
                try:
                    opened = pa.ipc.open_file(data)
                except pa.ArrowInvalid:
                    data.seek(0)
                    opened = pa.ipc.open_stream(data)
                yield from (x.select(names).cast(shape) for x in opened.read_all().to_batches())

    held = {"bool": pa.bool_(), "int64": pa.int64(), "double": pa.float64(), "string": pa.string(), "float_vector": pa.list_(pa.float32()), "double_vector": pa.list_(pa.float64())}[value_type]
    shape = pa.schema([("entity_id", pa.string()), ("event_time_us", pa.int64()), ("value", held), ("write_id", pa.string())])
    names = shape.names
    kind = {"bool": "boolean", "int64": "bigint", "double": "double", "string": "string", "float_vector": "array<float>", "double_vector": "array<double>"}[value_type]
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(tables, f"entity_id string, event_time_us bigint, value {kind}, write_id string")
    return _input(rows, tenant_id, entity_type, feature_id, typed(value_type, F.col("value")), source_id)


def driving_table(spark: SparkSession, uri: str, format: str = "parquet", row_id: str = "row_id", entity_id: str = "entity_id", event_time: str = "label_time_us", system_time: str | None = None, tenant_id: str = "default", entity_type: str = "entity") -> DataFrame:
    """A driving table in any of Spark's formats, with its columns named."""
    rows = spark.read.format(format).load(uri)
    return rows.select(F.col(row_id).cast("string").alias("row_id"), F.lit(tenant_id).alias("tenant_id"), F.lit(entity_type).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), F.col(event_time).cast("bigint").alias("label_time_us"), (F.col(system_time).cast("bigint") if system_time else F.lit(None).cast("bigint")).alias("system_cutoff_us")).to(DRIVING)


def write_dataset(dataset: DataFrame, uri: str, format: str = "PARQUET") -> None:
    """PARQUET to any of Spark's stores, by all executors. ARROW_FILE and ARROW_STREAM write one local file, batch by batch."""
    if format == "PARQUET":
        dataset.write.mode("overwrite").parquet(uri)
        return
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(dataset.schema)
    opener = {"ARROW_FILE": pa.ipc.new_file, "ARROW_STREAM": pa.ipc.new_stream}[format]

    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.cast(shape).serialize().to_pybytes()], pa.binary())], ["data"])

    with opener(uri, shape) as out:
        for row in dataset.mapInArrow(encoded, "data binary").toLocalIterator():  # one partition at a time, as Arrow bytes
            out.write_batch(pa.ipc.read_record_batch(pa.py_buffer(row.data), shape))
