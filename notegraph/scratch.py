"""Tables written between the steps of a job.

Iterative operators cut their lineage by writing a parquet table below the shared folder that the session names in
``spark.checkpoint.dir``; every executor sees it, so the loss of one costs a task retry and no more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffles of an execution are deleted at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_written: list[str] = []
_held: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. Where the setting is absent a local master gets a temporary one, a cluster gets an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-notegraph-"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a new scratch table, deleted by ``release``."""
    path = f"{scratch_dir(spark)}/notegraph/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write(df: DataFrame, label: str) -> str:
    """Write ``df`` to a new scratch table and return its path. Its shuffles have then been read for the last time and their
    files go at once; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path


def read(spark: SparkSession, paths: str | list[str], like: DataFrame) -> DataFrame:
    """Read scratch tables written with the schema of ``like``."""
    return spark.read.schema(like.schema).parquet(*([paths] if isinstance(paths, str) else paths))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over what was written."""
    return read(df.sparkSession, write(df, label), df)


@contextmanager
def held() -> Iterator[None]:
    """Tables written inside stay when ``settled`` clears up around them."""
    before = len(_written)
    yield
    _held.update(_written[before:])


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written once; the other tables that it wrote on the way are deleted, so it must not share them."""
    before = len(_written)
    df = make()
    path = write(df, label)
    done = read(df.sparkSession, path, df)
    gone = [x for x in _written[before:] if x != path and x not in _held]
    _written[before:] = [x for x in _written[before:] if x not in gone]
    _delete(df.sparkSession, gone)
    return done


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    _written.remove(path)
    _delete(spark, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this process; results that still read them must have been consumed."""
    _delete(spark, _written)
    _written.clear()
    _held.clear()
