"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from notegraph.scratch import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected with each end of the undirected ``links`` (a, b).

    Every node first learns its smallest neighbour, then hands it on, so the rounds grow with the logarithm of the size.
    Aggregates replace neighbour lists: a node of any degree is reduced before the shuffle. Nulls and self-links do not
    count, repeated and reversed links are one; ends without any other end have no row. Other columns are ignored.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = materialize(edges.distinct(), "cc")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: every larger neighbour of u, and u, is linked to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialize(large.filter("a <> b"), "cc-large")
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.join(least, large["b"] == least["u"]).select(F.col("m"), F.col("a"), F.col("u"))
        small = moved.select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b")).filter("a <> b").distinct()
        seen = Observation()
        mark = F.hash("a", "b").cast("bigint")
        small = materialize(small.observe(seen, F.count("*").alias("n"), F.sum(mark).alias("s")), "cc-small")
        old = edges.agg(F.count("*").alias("n"), F.sum(mark).alias("s")).first()
        if (old["n"], old["s"]) == (seen.get["n"], seen.get["s"]) and small.exceptAll(edges).isEmpty():
            break
        edges = small
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
