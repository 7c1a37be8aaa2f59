"""The newest event of every timeline as a stream: Spark keeps one winner per timeline as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from duochron.operators.reads import latest


def latest_updates(events: DataFrame) -> DataStreamWriter:
    """A writer of changed winners in update mode; tombstones come as answers that aren't found. Late facts update their timeline whenever they come."""
    return latest(events).writeStream.outputMode("update")
