"""One Spark session for all tests, and the comparison of a query with its reference SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # the tables of the tests are small: compiling a plan takes longer than running it interpreted
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain(value):
    if pd.isna(value):
        return None
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def same_rows(spark, duck, query, sql) -> None:
    got = query(spark, DATA).toPandas()
    want = duck.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(str, map(_plain, row))) for row in frame[columns].astype(object).itertuples(index=False)) for frame in (got, want)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def parity(spark, duck):
    return lambda query, sql: same_rows(spark, duck, query, sql)
