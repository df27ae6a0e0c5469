"""Search words found over arrays, and rows that workers read from the scratch folder themselves."""

import pyarrow as pa
from pyspark.sql import functions as F

from notegraph.functions import text as tx
from notegraph.operators import retrieval
from notegraph.sources.tables import spread

TEXTS = ["Ab c_dİx Kx9", None, "", "a", "é", "tail", "head Two", "xßyZ1_ q ends_", "İİ aKb", "many  the and 12 1"]


def test_words_equal_the_column_function(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    want = {r.id: r.w for r in rows.select("id", tx.search_words(F.col("text")).alias("w")).collect()}
    for cut in (0, 3):
        row, words = retrieval._words(pa.array(["before", *TEXTS]).slice(1 + cut))
        got = {i: [] for i in range(cut, len(TEXTS))}
        for r, w in zip(row, words.to_pylist()):
            got[r + cut].append(w)
        assert got == {i: w for i, w in want.items() if i >= cut}


def test_index_of_files_equals_one_of_postings(spark, tmp_path):
    texts = [(f"n{i:02}", f"alpha{i % 3} beta{i % 5} gamma{i % 7} gamma{i % 7} word{i}") for i in range(40)]
    docs = spark.createDataFrame([*texts, ("none", None), ("stop", "the and")], "id string, text string")
    index = retrieval.build_index(docs)
    retrieval.save_index(index, str(tmp_path / "index"))
    stored = retrieval.load_index(spark, str(tmp_path / "index"))
    assert index.n_docs == 42
    assert {(r.term, r.df) for r in index.terms.collect()} == {(r.term, r["count"]) for r in index.postings.groupBy("term").count().collect()}
    for make in (retrieval.similar, retrieval.distinctive_terms):
        some, other = ({tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in make(i).collect()} for i in (index, stored))
        assert some == other and some


def test_spread_does_not_run_a_shuffle(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    spark.sparkContext.setJobGroup("spread", "spread")
    some = spread(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("spread")) == 0
    assert some.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_seeds_cut_a_body_once_and_keep_what_is_no_note(spark, monkeypatch):
    notes = spark.createDataFrame([("n1", ["Ops"], "t", "alpha beta"), ("n2", None, None, "beta"), ("n3", [], "gamma", "")], "id string, tags array<string>, title string, body string")
    refs = spark.createDataFrame([("n2", "alpha"), ("gone", "alpha")], "source string, target string")
    topics = spark.createDataFrame([("q", "alpha ops"), ("r", "gamma")], "query_id string, text string")
    plans, whole = {}, retrieval.materialize

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return whole(df, label)

    monkeypatch.setattr(retrieval, "materialize", seen)
    got = {(r.query_id, r.id, round(r.strength, 6)) for r in retrieval.seeds(topics, notes, refs).collect()}
    assert got == {("q", "n1", 1.3), ("q", "n2", 1.0), ("q", "gone", 1.0), ("r", "n3", 0.5)}
    assert plans["signals"].count("split(") == 1
