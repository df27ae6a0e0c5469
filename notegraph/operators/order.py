"""Places in a global or grouped order, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.scratch import materialize


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """The rows with ``name``: their place from 1 on within the group (all rows without one) by ``order``.

    The rows are range-partitioned on group and order, so a group is spread over as many tasks as it needs; a place is the
    place within the task's range plus the sizes of the group's ranges before. Equal rows get places in any order.
    """
    keys = [*(F.col(g) for g in group), *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftrightunsigned("_at", 33)), "ordered")
    ranges = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_size"))
    # one row for each range that a group has
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_from") + 1)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "_part")]
    on = same[0]
    for more in same[1:]:
        on = on & more
    joined = placed.alias("r").join(ranges.alias("o"), on)
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_at") + F.col("_before")).alias(name))


def beside(rows: DataFrame, group: Sequence[str], step: int, columns: dict[str, str], name: str = "n") -> DataFrame:
    """Numbered rows with columns of the row ``step`` places on in the same group (``columns``: theirs to new), null at the ends."""
    other = rows.select(*[F.col(g).alias(f"_{g}") for g in group], (F.col(name) - step).alias("_n"), *[F.col(c).alias(as_) for c, as_ in columns.items()])
    on = F.col(name) == F.col("_n")
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return rows.join(other, on, "left").drop("_n", *[f"_{g}" for g in group])


def quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> tuple[int, list[float | None]]:
    """Number of the non-null values, and their quantiles with linear interpolation, picked off one global order."""
    placed = numbered(rows.filter(F.col(value).isNotNull()).select(value), [], [F.col(value)])
    total = placed.count()
    if not total:
        return 0, [None] * len(shares)
    at = [p * (total - 1) for p in shares]
    wanted = sorted({int(x) + k for x in at for k in (1, 2)})
    held = dict(placed.filter(F.col("n").isin(wanted)).select("n", value).collect())
    return total, [held[int(x) + 1] + (held.get(int(x) + 2, held[int(x) + 1]) - held[int(x) + 1]) * (x - int(x)) for x in at]
