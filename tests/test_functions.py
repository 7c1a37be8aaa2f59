from datetime import datetime

import pytest
from pyspark.sql import functions as F

from duochron.functions import literals, timeutil


@pytest.mark.parametrize(("said", "micros"), [(datetime(2024, 1, 1), 1704067200000000), (12, 12), (1.5, 1500000), ("77", 77), ("2024:01:01:00:00:00", 1704067200000000), ("2024-01-01 00:00:00.5", 1704067200500000), ("2024-01-01T00:00:00Z", 1704067200000000)])
def test_to_micros(said, micros):
    assert timeutil.to_micros(said) == micros


def test_bad_times_and_ranges():
    for bad in ("soon", None, True):
        with pytest.raises(ValueError):
            timeutil.to_micros(bad)
    assert timeutil.to_range((20, 10)) == (10, 20) and timeutil.to_range(5) == (5, None)
    with pytest.raises(ValueError):
        timeutil.to_range((10, 20))


def test_literals(spark):
    rows = spark.createDataFrame([("[1, 2.5]", "true", "12", "a, b,,c"), ("[]", "0", "12abc", ""), ("[1,,2]", "x", " 7", None)], "v string, b string, i string, t string")
    got = rows.select(literals.parse_vector(F.col("v")).alias("v"), literals.parse_bool(F.col("b")).alias("b"), literals.parse_value(F.col("i"), "int64")["int64_value"].alias("i"), literals.tags_from_text(F.col("t")).alias("t")).collect()
    assert [(r.v, r.b, r.i, r.t) for r in got] == [([1.0, 2.5], True, 12, ["a", "b", "c"]), ([], False, None, []), (None, None, 7, None)]
    assert [literals.literal_of(x) for x in (True, 3, 1.5, "s", [1, 2])] == ["true", "3", "1.5", "s", "[1.0,2.0]"]
    with pytest.raises(TypeError):
        literals.literal_of(None)
    ids = rows.select(literals.content_write_id("v", "t").alias("w"), literals.checksum(F.lit("123456789")).alias("c")).collect()
    assert len({r.w for r in ids}) == 3 and ids[0].c == 0xCBF43926
