"""Access to the parquet tables of one data folder and the columns shared by several operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(value: Column) -> Column:
    """Without spaces, tabs and line ends on both sides."""
    return F.btrim(value, F.lit(BLANKS))


def folded(value: Column) -> Column:
    return F.lower(trimmed(value))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 00:00:00 UTC of a timestamp column with or without a zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def distinct_notes(notes: DataFrame, *columns: str) -> DataFrame:
    """One row per note id with the given columns; repeated rows of an id are identical, rows without id do not count."""
    picked = [F.any_value(F.col(c), F.lit(False)).alias(c) for c in columns]
    return notes.filter(F.col("id").isNotNull()).groupBy("id").agg(*picked) if picked else (
        notes.filter(F.col("id").isNotNull()).select("id").distinct()
    )


def version(spark: SparkSession, folder: str, *names: str) -> str:
    """A name of the present state of tables: it changes when a file comes, goes, grows or is written again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in names:
        root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        for file in sorted(root.getFileSystem(conf).globStatus(root), key=lambda f: f.getPath().toString()):
            held = root.getFileSystem(conf).getContentSummary(file.getPath())
            seen.append(f"{file.getPath()}|{held.getLength()}|{held.getFileCount()}|{file.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


#: Bytes of stored input for each core from which adaptive execution is left to spread the rows of a shuffle.
_SPREAD = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores; a small table in one file else keeps one core busy.

    To ask a plan with a shuffle for its partitions would run it, so there the size of what it reads decides.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    run = rows._jdf.queryExecution()
    if run.executedPlan().nodeName() != "AdaptiveSparkPlan":
        few = rows.rdd.getNumPartitions() < cores
    else:
        leaves = run.optimizedPlan().collectLeaves()
        few = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) < cores * _SPREAD
    return rows.repartition(cores) if few else rows
