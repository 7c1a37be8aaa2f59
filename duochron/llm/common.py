"""Shared plumbing of the corpus operators.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` (the folder that a
cluster shares between driver and executors) and read again, which also cuts lineage, so a lost
executor costs only the running stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch, and its bytes, which bound it where texts are very long.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20

#: The Unicode White_Space property, which the splitting patterns call \s.
WHITE_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where none is set (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='duochron-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing lazily reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished stages now and not at the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[Iterable[dict]], Iterator[dict]]], schema: str, barrier_rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow over Python columns.

    ``make()`` runs once per task and returns a function from an iterator of column dicts
    (name -> pyarrow array) to an iterator of column dicts (name -> values, in the order of ``schema``).
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(barrier_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for made in make()(columns):
            yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(made.values(), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """``doc_id`` as bigint and the text with null as empty; other columns are left out, so their names can't clash."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in more))


def fold_words(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8 with A-Z lower-cased; bytes.split() and lower() know just these characters."""
    return text.encode().lower().split()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the operators deal out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
