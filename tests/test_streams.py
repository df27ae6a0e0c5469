"""Streams over more files than one micro-batch takes, in an order that has nothing to do with time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notegraph.streaming import access


@pytest.mark.parametrize("length,slide,windows", [("1 day", None, 1), ("7 days", "1 day", 7)])
def test_windows_over_many_batches(spark, tmp_path, length, slide, windows):
    start = datetime(2017, 1, 1)
    rows = [(start + timedelta(minutes=(i * 7919) % 43200), f"k{i % 3}") for i in range(1200)]  # 30 days
    # the latest days stand in the first files
    by_age = sorted(rows, key=lambda r: r[0], reverse=True)
    for k in range(12):
        part = by_age[100 * k : 100 * (k + 1)] + [(None, "k0")]
        spark.createDataFrame(part, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = access.stream_of(spark, str(tmp_path), "events", files_per_batch=2)
    found = access.windowed_counts(stream, "ts", "kind", length, slide)
    assert found.agg(F.sum("n")).first()[0] == 1200 * windows
    whole = spark.read.parquet(str(tmp_path / "events.parquet")).filter("ts is not null")
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    want = whole.groupBy(span.alias("w"), "kind").agg(F.count("*").alias("n")).select("w.start", "kind", "n")
    assert sorted(map(tuple, found.select("start", "key", "n").collect())) == sorted(map(tuple, want.collect()))
