"""Streaming counterparts of the log aggregates: each micro-batch adds its share once, whatever is replayed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.scratch import scratch_dir


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The files of a table as a stream, whether it is a folder of files or one file; a pattern fits either."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")


def drain(rows: DataFrame, label: str, share: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over what is available now and return what it wrote.

    Each batch overwrites the folder of its own number, so a batch that is run again after a failure counts once.
    """
    spark = rows.sparkSession
    base = f"{scratch_dir(spark)}/notegraph/{label}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        share(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def access_counts(log: DataFrame) -> DataFrame:
    """mote_id, n, last: per batch partial counts, added up on reading."""

    def share(batch: DataFrame) -> DataFrame:
        rows = batch.filter("mote_id is not null and accessed_at is not null")
        return rows.groupBy("mote_id").agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))

    parts = drain(log.select("mote_id", "accessed_at"), "access-counts", share)
    return parts.groupBy("mote_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def windowed_counts(events: DataFrame, time: str, key: str, length: str, slide: str | None = None) -> DataFrame:
    """start, key, n per window: per batch partial counts, added up on reading. Rows without time do not count.

    No watermark: a replay reads files in any order, so no row is too late.
    """

    def share(batch: DataFrame) -> DataFrame:
        span = F.window("_at", length, slide) if slide else F.window("_at", length)
        counts = batch.filter("_at is not null").groupBy(span.alias("w"), "key").agg(F.count("*").alias("n"))
        return counts.select(F.col("w.start").alias("start"), "key", "n")

    parts = drain(events.select(F.col(time).cast("timestamp").alias("_at"), F.col(key).alias("key")), "windows", share)
    return parts.groupBy("start", "key").agg(F.sum("n").alias("n"))


def folded_edges(log: DataFrame) -> DataFrame:
    """source, target, edge_type of the edges that no line of the log deletes."""
    key = ["source", "target", "edge_type"]

    def share(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*key).agg(F.bool_or(F.coalesce("deleted", F.lit(False))).alias("gone"))

    parts = drain(log.select(*key, "deleted"), "edges", share)
    return parts.groupBy(*key).agg(F.bool_or("gone").alias("gone")).filter("not gone").select(*key)


def session_counts(log: DataFrame, entity: Column, time: str, gap_us: int, flag: str, delay: str | None = None) -> DataFrame:
    """entity, start, last, n, n_flagged of each entity's sessions over a stream of events; gaps of exactly ``gap_us`` do not split.

    Without ``delay`` every session is kept in the state and the whole result is given again after each batch, so no row is
    ever too late. With a ``delay`` (a watermark such as ``7 days``) finished sessions leave the state, and rows that come
    later than that are lost. Rows without entity or time do not count.
    """
    spark = log.sparkSession
    base = f"{scratch_dir(spark)}/notegraph/sessions-{uuid.uuid4().hex}"
    rows = log.select(entity.alias("entity"), F.col(time).cast("timestamp").alias("at"), F.coalesce(flag, F.lit(False)).alias("flag")).filter("entity <> '' and at is not null")
    if delay is not None:
        rows = rows.withWatermark("at", delay)
    span = F.session_window("at", f"{gap_us} microseconds")
    counts = rows.groupBy("entity", span.alias("w")).agg(F.max("at").alias("last"), F.count("*").alias("n"), F.count(F.when(F.col("flag"), 1)).alias("n_flagged"))

    def keep(batch: DataFrame, number: int) -> None:
        out = batch.select("entity", F.col("w.start").alias("start"), "last", "n", "n_flagged")
        out.write.mode("overwrite").parquet(f"{base}/out" if delay is None else f"{base}/out/batch={number}")

    mode = "complete" if delay is None else "append"
    query = counts.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").select("entity", "start", "last", "n", "n_flagged")
