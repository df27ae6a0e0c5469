"""A mix of several sources in which each has its target share of the tokens, by Poisson replication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.sources.tables import folded

SEED = 20_240_315
#: Targets of up to so many sources and bytes are broadcast; beyond, both sides are salted and shuffled.
BROADCAST_SOURCES = 10_000
BROADCAST_BYTES = 16 << 20
SALTS = 64


def truncated_poisson(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0 .. cap - 1 of a Poisson X whose minimum with ``cap`` has the mean ``rate``.

    A rate of ``cap`` or more gives zeros (always ``cap`` copies), a rate of 0 or less ones (no copy).
    """
    if rate >= cap:
        return [0.0] * cap
    if rate <= 0:
        return [1.0] * cap
    k = np.arange(cap)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))])

    def below(mean: float) -> np.ndarray:
        return np.minimum(np.cumsum(np.exp(k * np.log(mean) - mean - log_factorial)), 1.0)

    low, high = rate, rate + 1.0
    while (1 - below(high)).sum() < rate and high < 1e6:
        high *= 2
    for _ in range(100):
        mean = (low + high) / 2
        low, high = (mean, high) if (1 - below(mean)).sum() < rate else (low, mean)
    return below((low + high) / 2).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _copies_cdf(rate: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([truncated_poisson(float(r), int(c)) for r, c in zip(rate, cap)])


def sized(documents: DataFrame, size: Column) -> DataFrame:
    """doc_id, source (folded), size: what planning and drawing need of the documents; a null size counts as 0."""
    return documents.select("doc_id", folded(F.col("source")).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))


def _attach(left: DataFrame, plan: DataFrame) -> DataFrame:
    row = 64 + F.octet_length("source") + 8 * F.size("cdf")
    n, held = plan.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    if n <= BROADCAST_SOURCES and held <= BROADCAST_BYTES:
        return left.join(F.broadcast(plan), "source")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["source", "salt"]).drop("salt")


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, n_docs, size, total, rate, reachable for every listed source.

    ``total`` is the size of the mix, by default that of all documents of listed sources counted once. ``rate`` is the mean
    number of copies of a document; where even ``max_repeats`` copies of each stay below the share, ``reachable`` is false
    and the rate is ``max_repeats``. A listed source without documents has size 0. Targets without source do not count; of
    repeated ones the largest share and repeats count. Documents without a listed source are in no mix.
    """
    wanted = targets.select(folded(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
    wanted = wanted.groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    held = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("size"))
    plan = wanted.join(held, "source", "left").fillna(0, ["n_docs", "size"])
    if total is None:
        total = plan.agg(F.sum("size")).first()[0] or 0
    aim = F.col("target_share") * F.lit(int(total))
    most = F.col("size") * F.col("max_repeats")
    rate = F.when(most < aim, F.col("max_repeats").cast("double")).when(F.col("size") > 0, aim / F.col("size")).otherwise(F.lit(0.0))
    return plan.select("*", F.lit(int(total)).cast("bigint").alias("total"), rate.alias("rate"), (most >= aim).alias("reachable"))


def draw(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, n_copies of every document of a listed source.

    The number of copies inverts the Poisson distribution of the source at a uniform number hashed from ``doc_id``, so it
    depends on nothing else: reruns and repartitioning give the same mix.
    """
    chances = plan.select("source", _copies_cdf("rate", "max_repeats").alias("cdf"))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
    drawn = _attach(sizes, chances).withColumn("u", uniform)
    copies = F.size(F.filter("cdf", lambda c: c <= F.col("u"))).cast("int")
    return drawn.select("doc_id", "source", "size", copies.alias("n_copies"))


def mix(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, copy, place: one row for each copy, in the global order of ``place``, a hash of document and copy."""
    copies = drawn.filter("n_copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    return copies.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed + 1))).orderBy("place", "doc_id", "copy")


def _drawn_sizes(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_copies")).alias("mix_size"), F.max("n_copies").alias("most_copies"), F.min("n_copies").alias("least_copies")
    )


def short_sources(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """The listed sources that cannot reach their share, with target_share, target_size and mix_size, as the draw shows it.

    The distribution fitted to such a source gives every document ``max_repeats`` copies, and the mix still holds less than the
    source's target. A source that could reach its share but drew somewhat less has documents with fewer copies; should all of
    them have the most by chance, it has reached its share. A source without documents draws nothing.
    """
    report = plan.join(_drawn_sizes(drawn), "source", "left").fillna(0, ["mix_size"])
    aim = F.col("target_share") * F.col("total")
    full = F.coalesce("least_copies", "max_repeats") >= F.col("max_repeats")
    return report.filter(full & (F.col("mix_size") < aim)).select("source", "target_share", aim.alias("target_size"), "mix_size")


def mix_report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and reached share, size in the mix and the most copies of a document, for every listed source.

    ``share_of_total`` is what the source has of the planned total, ``actual_share`` of what the mix really holds, which is
    less where sources are not reachable.
    """
    report = plan.join(_drawn_sizes(drawn), "source", "left").fillna(0, ["mix_size", "most_copies"])
    whole = report.agg(F.sum("mix_size")).first()[0] or 0
    share = F.col("mix_size") / F.lit(float(whole)) if whole else F.lit(0.0)
    planned = F.when(F.col("total") > 0, F.col("mix_size") / F.col("total")).otherwise(0.0)
    return report.select(
        "source", "target_share", "max_repeats", "n_docs", "size", "rate", "reachable", "mix_size", "most_copies",
        planned.alias("share_of_total"), share.alias("actual_share"),
    )
