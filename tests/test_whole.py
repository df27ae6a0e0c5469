"""Cases in which a shortened job gives other rows than the whole one."""

from notegraph.operators import graph, notes, retrieval


def test_shared_terms_are_tags_and_concepts_without_linked_pairs(spark):
    rows = [("a", "active", ["x", "y"]), ("b", "active", ["x", "y"]), ("c", "deprecated", ["x", "y", "z"]), ("d", None, ["x", "y", "z"]), ("e", "active", ["x", "y", "z"])]
    found = spark.createDataFrame(rows, "id string, status string, tags array<string>")
    concepts = [(n, t, "concept_ref") for n, t in [("a", "p"), ("b", "p"), ("c", "p"), ("c", "q"), ("c", "r"), ("f", "p"), ("f", "q"), ("f", "r")]]
    edges = spark.createDataFrame([*concepts, ("f", "c", "relates_to"), ("d", "e", "relates_to")], "source string, target string, edge_type string")
    # the link of c and f goes from the larger id to the smaller one, so it does not count
    assert set(map(tuple, notes.link_candidates(found, edges).collect())) == {("a", "b", 3), ("c", "f", 3)}


def test_levels_of_a_long_chain(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("x", "y"), ("y", "x"), ("n70", "n69")]
    found = {r.node: r.level for r in graph.levels(spark.createDataFrame(chain, "source string, target string")).collect()}
    assert found == {f"n{i}": i for i in range(71)}


def test_seeds_count_the_text_search(spark):
    rows = [("a", [], "deploy", "nothing here"), ("b", ["cache"], "", "cache cache"), ("c", [], "a snake_case word", "plain"), ("d", [], "snake_case", "")]
    found = spark.createDataFrame(rows, "id string, tags array<string>, title string, body string")
    topics = spark.createDataFrame([("deploy", "deploy"), ("cache", "cache"), ("snake", "cache snake_case")], "query_id string, text string")
    index = retrieval.build_index(found.selectExpr("id", "concat(title, ' ', body) as text"))
    none = spark.createDataFrame([], "source string, target string")
    got = {(r.query_id, r.id): round(r.strength, 6) for r in retrieval.seeds(topics, found, none, index=index).collect()}
    assert got["deploy", "a"] == 0.5 + 0.5 and got["cache", "b"] == 1.0 + 0.3 + 0.5
    # only the search finds c and d here: "snake_case" is one word to it and two to the keywords, and the topic has a tag hit
    assert {k for k in got if k[0] == "snake"} == {("snake", "b"), ("snake", "c"), ("snake", "d")}
    assert got["snake", "b"] == 1.0 + 0.3 + 0.5 and 0 < got["snake", "c"] < got["snake", "d"] < 0.5


def test_search_finds_provider_and_id_of_references(spark):
    kind = "id string, title string, body string, external_refs array<struct<provider: string, id: string, url: string>>"
    rows = [("a", "t", "x", [("jira", "OPS7", None), (None, "k2", "u")]), ("b", None, "x", None), ("c", "t", "x", [])]
    docs = spark.createDataFrame(rows, kind).select("id", notes.search_text().alias("text"))
    assert {r.id: r.text for r in docs.collect()} == {"a": "t x jira OPS7  k2", "b": " x", "c": "t x"}
    found = retrieval.search(retrieval.build_index(docs), spark.createDataFrame([("q", "ops7")], "query_id string, text string"))
    assert [r.id for r in found.collect()] == ["a"]


def test_every_twentieth_document_is_a_query(spark):
    from notegraph.plans.retrieval import r02_document_search
    from tests.conftest import DATA

    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id % 20 = 0").collect()}
    found = {r.query_id for r in r02_document_search(spark, DATA).select("query_id").distinct().collect()}
    assert found and found <= ids
    assert len(found) > 0.5 * len(ids)


def test_inferred_tags_are_the_first_five_in_order(spark):
    rows = [("a", "zeta alpha other mu beta zeta nu kappa", ["alpha", "beta", "kappa"]), ("b", "plain", ["mu", "nu", "zeta"]), ("c", None, None)]
    found = notes.inferred_tags(spark.createDataFrame(rows, "id string, title string, tags array<string>"))
    assert {r.id: r.tags for r in found.collect()} == {"a": ["zeta", "alpha", "mu", "beta", "nu"]}


def test_readiness_over_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 300, []
    whole = graph.write
    monkeypatch.setattr(graph, "write", lambda df, label: (rounds.append(label), whole(df, label))[1])
    # two chains of done notes behind a task each: one ends at a live note, the other at a done one; a third leads past a live note
    rows = [("t1", "task", "active", ["a0"]), ("t2", "task", "active", ["b0"]), ("t3", "task", "active", ["c0"]), ("live", "task", "in_progress", [])]
    for i in range(n):
        rows += [(f"a{i}", "task", "completed", [f"a{i + 1}" if i < n - 1 else "live"]), (f"b{i}", "task", "completed", [f"b{i + 1}"] if i < n - 1 else [])]
    rows += [("c0", "task", "completed", ["c1"]), ("c1", "task", "active", ["c2"]), ("c2", "task", "completed", [])]
    found = spark.createDataFrame(rows, "id string, type string, status string, depends_on array<string>")
    assert {r.id for r in graph.ready(found).collect()} == {"t2", "c1"}
    assert rounds.count("blocked") < 20
