"""What is deleted on the way, and what queries no longer carry."""

import random

from pyspark.sql import functions as F

from notegraph import scratch
from notegraph.operators import graph, retrieval
from notegraph.plans import search
from tests.test_products import moved


def test_settled_leaves_its_result_and_what_is_held(spark):
    seen = {}

    def make():
        first = scratch.materialize(spark.range(5), "first")
        with scratch.held():
            kept = scratch.materialize(spark.range(3), "kept")
        seen.update(first=first.inputFiles()[0], kept=kept.inputFiles()[0])
        return first.join(kept, "id")

    done = scratch.settled(make, "done")
    assert not scratch.exists(spark, seen["first"]) and scratch.exists(spark, seen["kept"]) and done.count() == 3


def test_chunks_are_sought_only_in_corpora_pointed_to(spark):
    rng = random.Random(1)
    chunks = spark.createDataFrame([(f"c{i % 8}", f"c{i % 8}-{i}", " ".join(rng.choice(["oak", "elm", "ash", "fir"]) for _ in range(5))) for i in range(400)], "corpus string, id string, text string")
    topics = spark.createDataFrame([(f"q{i}", "oak elm") for i in range(300)], "query_id string, text string")
    within = spark.createDataFrame([(f"q{i}", f"c{i % 8}") for i in range(0, 300, 2)] + [("q0", "c1"), ("q0", "none")], "query_id string, corpus string")
    corpora = retrieval.build_corpora(chunks)
    whole, n_whole = moved(spark, lambda: retrieval.search_corpora(corpora, topics, 2))
    some, n = moved(spark, lambda: retrieval.search_corpora(corpora, topics, 2, within))
    pairs = {tuple(r) for r in within.collect()}
    assert {tuple(r) for r in some} == {tuple(r) for r in whole if (r.query_id, r.corpus) in pairs} and len(some) == 151 * 2
    assert n < n_whole / 2


def test_traversal_leaves_out_links_that_cannot_pass(spark):
    notes = spark.range(600).select(F.format_string("n%04d", "id").alias("id"), F.when(F.col("id") < 20, 0.9).otherwise(-2.0).alias("weight"), F.lit("active").alias("status"), F.lit("human").alias("origin"), F.lit("note").alias("type"), F.lit(0).alias("access_count"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_accessed"))
    edges = notes.filter("id <> 'n0000'").select(F.lit("n0000").alias("source"), F.col("id").alias("target"), F.lit("relates_to").alias("edge_type"))
    edges = edges.unionByName(spark.createDataFrame([("n0003", "n0000", "contradicts")], edges.schema))
    seeds = spark.range(200).select(F.col("id").alias("query_id"), F.lit("n0000").alias("id"), F.lit(1).alias("seed_pos"))
    rows, n = moved(spark, lambda: graph.traverse(seeds, notes, edges, "2024-01-02 00:00:00"))
    scores = {r.id: round(r.score, 6) for r in rows if r.query_id == 7}
    assert len(rows) == 200 * 12 and max(scores) < "n0020"
    assert n < 60_000  # the links of all queries were 120,000


def test_disputed_seeds_are_found_once(spark, monkeypatch, tmp_path):
    edges = spark.createDataFrame([("a", "b", "contradicts", False)], "source string, target string, edge_type string, deleted boolean")
    calls = []

    def seeds(*_):
        mark = F.udf(lambda x: (open(f"{tmp_path}/{random.random()}", "w").close(), x)[1], "string")
        calls.append(1)
        return spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string").coalesce(1).select("query_id", mark("id").alias("id"))

    monkeypatch.setattr(search.base, "_seeds", seeds)
    monkeypatch.setattr(search, "table", lambda *_: edges)
    monkeypatch.setattr(search, "view", lambda *_: spark.createDataFrame([("a", "active"), ("b", "active")], "id string, status string"))
    assert [tuple(r) for r in search.j15_disputed(spark, "").collect()] == [("q", "a", 1)]
    assert len(calls) == 1 and len(list(tmp_path.iterdir())) == 2
