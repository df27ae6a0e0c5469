"""Effects of proposals, cycles, answers in prose, places in an order: small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators import graph, retrieval, review
from notegraph.operators.order import beside, numbered, quantiles
from notegraph.schema import LINK_TYPES

SHAPE = "pid string, kind string, action string, sources array<string>, targets array<string>, link_type string, rationale string, tags array<string>"


def notes(spark, rows):
    lists = ", ".join(f"{t} array<string>" for t in LINK_TYPES)
    return spark.createDataFrame([(i, k, s, t, *[links.get(x, []) for x in LINK_TYPES]) for i, k, s, t, links in rows], f"id string, type string, status string, tags array<string>, {lists}")


def test_effects_of_every_kind(spark):
    held = notes(spark, [(x, "lesson" if x in "ab" else "task", "active", ["t"], {"relates_to": ["e"]} if x == "a" else {}) for x in "abcde"])
    edges = spark.createDataFrame([("a", "e", "relates_to"), ("a", "b", "builds_on"), ("d", "b", "caused_by"), ("x", "a", "supersedes")], "source string, target string, edge_type string")
    rows = [
        ("1", "link_suggestion", "add", ["a"], ["b"], "counteracts", "r", []), ("2", "link_suggestion", "add", ["a"], ["zz"], "relates_to", "r", []),
        ("3", "staleness", "deprecate", ["c"], [], "", "r", []), ("4", "staleness", "flag", ["d"], [], "", "r", []), ("5", "tag_refinement", "x", ["d"], [], "", "r", ["n", "m"]),
        ("6", "compression", "x", ["e"], [], "", "short", []), ("7", "constellation", "x", ["a", "b"], [], "", "r", ["hub"]), ("8", "merge_suggestion", "x", ["a", "b", "c"], [], "", "T\nB", ["t"]),
        ("9", "merge_suggestion", "x", ["a", "b"], [], "", "T", ["t"]), ("10", "action_extraction", "x", ["b"], [], "", "do it", []), ("11", "signal", "s", [], [], "", "why", ["u", "v"]),
        ("12", "summarize", "x", ["c", "d", "e"], [], "", "S", []), ("13", "decay_risk", "x", ["a"], [], "", "r", []), ("14", "contradiction", "x", ["d", "e"], [], "", "r", []),
    ]
    got = {tuple(r) for r in review.applied_effects(spark.createDataFrame(rows, SHAPE), held, edges).collect()}
    assert {("edge", "a", "contradicts", "b"), ("edge", "b", "contradicts", "a"), ("link", "a", "contradicts", "b"), ("edge", "d", "contradicts", "e")} <= got
    assert ("set", "c", "status", "deprecated") in got and ("set", "d", "status", "deprecated") not in got
    assert {("set", "d", "tags", "n,m"), ("set", "e", "body", "short"), ("set", "b", "action", "do it"), ("signal", "s", "u,v", "why")} <= got
    assert {("note", "new-7", "constellation", "Constellation: hub"), ("note", "new-8", "lesson", "T"), ("note", "new-12", "context", "S")} == {x for x in got if x[0] == "note"}
    assert {("status", x, "deprecated", "new-8") for x in "abc"} == {x for x in got if x[0] == "status"}
    assert {("set", x, "status", "archived") for x in "cde"} <= got and ("edge", "c", "built_by_ref", "new-12") in got
    # links of merged notes move, those between them and supersedes do not
    assert ("edge", "new-8", "relates_to", "e") in got and ("edge", "d", "caused_by", "new-8") in got
    assert not any(x[0] == "edge" and x[1] == "new-8" and x[2] == "builds_on" for x in got)


@pytest.mark.parametrize(
    "text,want",
    [('say {"a": "}"} end', '{"a": "}"}'), ("```json\n[1, [2]]\n```", "[1, [2]]"), ("x ``` {\"k\": 1} ``` y", '{"k": 1}'), ("none", None), ('{"open": 1', None), (None, None), ("", None), ('{"a": "\\"}"}', '{"a": "\\"}"}')],
)
def test_json_in_prose(spark, text, want):
    rows = spark.createDataFrame([(text,)], "v string")
    assert rows.select(review.json_in(F.col("v")).alias("x")).first().x == want


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_cycles(spark, seed):
    rng = random.Random(seed)
    arcs = {(f"v{rng.randrange(15)}", f"v{rng.randrange(15)}") for _ in range(28)} | {("s", "s")}
    step = {a: {y for x, y in arcs if x == a} for a, _ in arcs}

    def length(start):
        seen, at, k = set(), {start}, 0
        while at:
            k += 1
            at = {y for x in at for y in step.get(x, ())} - seen
            if start in at:
                return k
            seen |= at

    nodes = {x for a in arcs for x in a}
    found = graph.shortest_cycles(spark.createDataFrame(list(arcs), "source string, target string"), spark.createDataFrame([(x,) for x in nodes], "id string")).collect()
    assert {r.id: len(r.cycle) for r in found} == {x: length(x) for x in nodes if length(x)}
    for r in found:
        assert r.id in r.cycle and r.cycle[0] == min(r.cycle) and all(pair in arcs for pair in zip(r.cycle, [*r.cycle[1:], r.cycle[0]]))


def test_places_in_an_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(50), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    placed = numbered(frame, ["g"], [F.desc("v"), F.col("i")])
    assert {r.i: r.n for r in placed.collect()} == want
    after = {(r.g, r.n): r.next_i for r in beside(placed, ["g"], 1, {"i": "next_i"}).collect() if r.g is not None}
    by_place = {(r[0], want[r[2]]): r[2] for r in rows if r[0] is not None}
    assert after == {(g, n): by_place.get((g, n + 1)) for g, n in by_place}
    assert quantiles(frame, "v", [0.5])[0] == 600 and quantiles(frame.limit(0), "v", [0.5]) == (0, [None])
    assert quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double"), "v", [0.5, 0.75]) == (3, [2.0, 3.0])


def test_words_inside_titles(spark):
    titles = {1: "over the moonlight", 2: "noon", 3: "a lighthouse by night", 4: "", 5: None, 6: "ab"}
    words = ["light", "oo", "moon", "a", "zzz", "night"]
    t = spark.createDataFrame([(k, v) for k, v in titles.items()], "id int, title string")
    w = spark.createDataFrame([("q", x) for x in words], "query_id string, word string")
    assert {(r.word, r.id) for r in retrieval.contained(w, t).collect()} == {(x, k) for x in words for k, v in titles.items() if v and x in v}


@pytest.mark.parametrize("least", [0.05, 0.3, 1.0])
def test_similar_texts_lose_nothing_to_bounds(spark, least):
    rng = random.Random(7)
    names = [f"w{i:02}" for i in range(60)]
    weights = [200 // (i + 1) + 1 for i in range(60)]
    docs = spark.createDataFrame([(f"d{k}", " ".join(rng.choices(names, weights, k=rng.randrange(2, 14)))) for k in range(80)], "id string, text string")
    index = retrieval.build_index(docs)
    asked = retrieval.distinctive_terms(index, 8).select(F.col("id").alias("src"), "term", "idf")
    every = asked.join(index.postings, "term").filter("src <> id").groupBy("src", "id").agg(F.round(F.sum(retrieval._weight(index)), 9).alias("score")).filter(F.col("score") >= least)
    want = {}
    for r in every.collect():
        want.setdefault(r.src, []).append((-r.score, r.id))
    got = {}
    for r in retrieval.similar(index, 3, least).collect():
        got.setdefault(r.src, []).append((-round(r.score, 9), r.id))
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(x)[:3] for s, x in want.items()}


def test_corpora_have_their_own_frequencies(spark):
    rows = [("a", "a1", "cache cache deploy"), ("a", "a2", "deploy plan"), ("b", "b1", "cache"), ("b", "b2", ""), ("c", "c1", None)]
    corpora = retrieval.build_corpora(spark.createDataFrame(rows, "corpus string, id string, text string"))
    assert {r.corpus: (r.n_docs, r.avg_len) for r in corpora.sizes.collect()} == {"a": (2, 2.5), "b": (2, 0.5), "c": (1, 0.0)}
    topics = spark.createDataFrame([("q", "cache")], "query_id string, text string")
    found = retrieval.search_corpora(corpora, topics, 5)
    assert {(r.corpus, r.id) for r in found.collect()} == {("a", "a1"), ("b", "b1")}
    whole = {c: retrieval.build_index(spark.createDataFrame([x[1:] for x in rows if x[0] == c], "id string, text string")) for c in "ab"}
    for r in found.collect():
        assert r.score == pytest.approx(retrieval.search(whole[r.corpus], topics).first().score)
    assert [r.rank for r in retrieval.merged(found, 1).collect()] == [1]


def test_an_index_is_kept_until_its_data_changes(spark, tmp_path):
    docs = spark.createDataFrame([("x", "one two three")], "id string, text string")
    first = retrieval.kept_index(docs, "kept", "v1")
    assert retrieval.kept_index(docs, "kept", "v1") is first and retrieval.kept_index(docs, "kept", "v2") is not first
    retrieval.save_index(first, str(tmp_path / "index"))
    again = retrieval.load_index(spark, str(tmp_path / "index"))
    assert (again.n_docs, again.avg_len, again.postings.count(), again.terms.count()) == (1, 3.0, 3, 3)


def test_corpus_names_of_chunks(spark):
    ids = spark.createDataFrame([("docs-a-1-2",), ("docs-1-2",), ("other-x-1-2",), ("plain",), ("a-b",), (None,)], "id string").filter("id is not null")
    known = spark.createDataFrame([("docs",), ("docs-a",)], "corpus string")
    assert {r.id: r.corpus for r in retrieval.corpus_of(ids, known).collect()} == {"docs-a-1-2": "docs-a", "docs-1-2": "docs", "other-x-1-2": "other-x", "plain": "plain", "a-b": "a-b"}
