from duochron.functions import sqltable
from duochron.operators import reads
from duochron.streaming.latest import latest_updates
from tests.test_reads import DDL, EXAMPLE, event, frame


def test_sql_functions(spark):
    frame(spark, [*EXAMPLE, event(9, "UPSERT", None, 5, 5, "f_null")]).createOrReplaceTempView("facts_here")
    sqltable.register(spark, "facts_here")
    got = {(r.feature_id, r.found, r.value) for r in spark.sql("select * from feature_as_of(105, 125)").collect()}
    assert got == {("f_price", True, 2.0), ("f_null", True, None)}
    assert spark.sql("select value from feature_latest() where feature_id = 'f_price'").first()[0] == 4.0


def test_latest_stream(spark, tmp_path):
    seen = {}

    def keep(batch, _):
        seen.update({r.feature_id: (r.found, r.value) for r in batch.collect()})

    for i, part in enumerate((EXAMPLE[:2], EXAMPLE[2:4], EXAMPLE[4:])):
        frame(spark, part).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        latest_updates(stream).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        row = reads.latest(frame(spark, EXAMPLE[: (2, 4, 5)[i]])).first()
        assert seen["f_price"] == (row.found, row.value)
