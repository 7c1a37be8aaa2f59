"""Streams into a store. Facts are never late: there is no watermark, and system time carries the delay.

Repeated write ids are found by a join with the table inside each micro-batch, so the stream's state
doesn't grow; a micro-batch that runs again after a failure finds its own writes and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from duochron.plans.store import Store
from duochron.schema import EVENT_INPUT


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENT_INPUT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events as JSON values; needs Spark's Kafka package on the class path."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT_INPUT).alias("e")).select("e.*")


def ingest(stream: DataFrame, store: Store, checkpoint: str, trusted: bool = False, once: bool = True) -> StreamingQuery:
    """Write every micro-batch; ``once`` stops when all that is there now has been written."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.write(batch, trusted) and None)
    return (query.trigger(availableNow=True) if once else query).start()
