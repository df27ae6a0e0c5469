"""Hand-computed cases of scoring, text functions, graph operators, chunks, review and changes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notegraph.functions import scoring as sc
from notegraph.functions import text as tx
from notegraph.operators import changes, chunks, graph, logs, notes, retrieval, review
from notegraph.schema import LINK_TYPES, Chunking

NOW = datetime(2024, 3, 15)
AS_OF = "2024-03-15 00:00:00"


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_score_of_a_full_note(spark):
    row = [(0.7, "active", "failure", "task", 3, NOW - timedelta(days=20), 1 / (7**0.5))]
    df = spark.createDataFrame(row, "weight double, status string, origin string, type string, access_count int, last_accessed timestamp, x double")
    matched = F.lit(1.0) / F.log2(F.lit(7.0))  # a tag that five notes have
    score = df.select(sc.relevance(F.lit("relates_to"), matched, F.lit(1), AS_OF).alias("s")).first().s
    assert score == pytest.approx((0.7 + 0.1 + 0.09 + 0.2 + 0.2 / 2.807354922 - 0.1) * 0.85, abs=1e-6)


@pytest.mark.parametrize("days,factor", [(0, 1.0), (6.9, 1.0), (7, 0.85), (29.9, 0.85), (30, 0.65), (89, 0.65), (90, 0.4), (None, 0.4)])
def test_recency(spark, days, factor):
    df = one(spark, None if days is None else NOW - timedelta(days=days), "timestamp")
    assert df.select(sc.recency(sc.age_days(F.col("v"), AS_OF)).alias("f")).first().f == factor


@pytest.mark.parametrize(
    "text,want",
    [("The Quick_brown fox, a x 42", ["quick_brown", "fox", "42"]), ("fox fox", ["fox", "fox"]), ("", []), (None, []), ("日本 ab", ["ab"])],
)
def test_search_tokens(spark, text, want):
    assert one(spark, text).select(tx.search_tokens(F.col("v")).alias("x")).first().x == want


@pytest.mark.parametrize("text,want", [("Über the Graph, graph of é", ["über", "graph", "é"]), (None, []), ("a b", [])])
def test_keywords(spark, text, want):
    assert one(spark, text).select(tx.keywords(F.col("v")).alias("x")).first().x == want


@pytest.mark.parametrize(
    "body,n",
    [("AKIA" + "A1B2" * 4, 1), ("sk-ant-" + "x" * 20, 1), ("-----BEGIN RSA PRIVATE KEY-----", 1), ("plain words", 0), (None, 0)],
)
def test_secrets(spark, body, n):
    from notegraph.schema import BLOCKING_PATTERNS

    assert len(one(spark, body).select(tx.secrets(F.col("v"), BLOCKING_PATTERNS).alias("x")).first().x) == n


@pytest.mark.parametrize("name,problem", [("ok-1.x", None), ("", "empty"), ("a..b", "path traversal"), ("a/b", "path separator"), ("con", "reserved"), ("a b", "invalid character"), ("x" * 101, "too long"), (None, "empty")])
def test_names(spark, name, problem):
    assert one(spark, name).select(tx.name_problem(F.col("v")).alias("x")).first().x == problem


def test_checklist_and_hook(spark):
    text = "# Head\n\n- [ ] one\n- [x] two\n * [x] no\n- [X] three"
    rows = one(spark, text).select(F.inline(tx.checklist(F.col("v")))).collect()
    assert [tuple(r) for r in rows] == [(False, "one"), (True, "two"), (True, "three")]
    assert one(spark, "# H\n\n- **bold** __it__").select(tx.body_hook(F.col("v")).alias("x")).first().x == "bold it"
    assert one(spark, None).select(tx.body_hook(F.col("v")).alias("x")).first().x == ""


def note_rows(spark, rows):
    """Rows of (id, overrides) as notes with all list columns."""
    names = ["id", "type", "status", "title", "body", "parent", "weight", "origin", "access_count", "last_accessed", "tags", *LINK_TYPES]
    kinds = ["string"] * 6 + ["double", "string", "int", "timestamp"] + ["array<string>"] * (1 + len(LINK_TYPES))
    base = {"type": "task", "status": "active", "title": "t", "body": "", "weight": 0.5, "origin": "normal", "access_count": 0, "last_accessed": NOW}
    data = [tuple({**base, "id": i, **{c: [] for c in ["tags", *LINK_TYPES]}, **o}.get(c) for c in names) for i, o in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def test_readiness(spark):
    df = note_rows(spark, [("free", {}), ("done", {"status": "completed"}), ("after", {"depends_on": ["done"]}), ("waits", {"depends_on": ["free"]}),
                           ("far", {"depends_on": ["done2"]}), ("done2", {"status": "completed", "depends_on": ["gone"]}), ("busy", {"status": "in_progress"}),
                           ("loop", {"depends_on": ["l1"]}), ("l1", {"status": "completed", "depends_on": ["l2"]}), ("l2", {"status": "completed", "depends_on": ["l1"]})])
    assert {r.id for r in graph.ready(df).collect()} == {"free", "after", "loop"}


def test_edges_and_broken_links(spark):
    df = note_rows(spark, [("p-a", {"builds_on": ["p-b"], "body": "[[p-b]] [[p-a]] [[idea]] [[idea]]"}), ("p-b", {"parent": "p-a", "relates_to": ["p-x", "q-y"]})])
    edges = {tuple(r) for r in graph.edges_of(df).collect()}
    assert {("p-a", "p-b", "builds_on"), ("p-b", "p-a", "built_by_ref"), ("p-b", "p-a", "child_of"), ("p-a", "p-b", "parent_of"), ("p-a", "p-b", "body_ref"), ("p-a", "idea", "concept_ref")} <= edges
    assert len(edges) == 8
    assert {(r.target, r.problem) for r in graph.broken_links(df).collect()} == {("p-x", "broken_link"), ("q-y", "cross_project_ref")}


def test_any_tombstone_wins(spark):
    log = spark.createDataFrame([("a", "b", "x", False), ("a", "b", "x", True), ("a", "b", "x", False), ("a", "c", "x", None), ("a", "c", "x", False)], "source string, target string, edge_type string, deleted boolean")
    assert [tuple(r) for r in graph.live_edges(log).collect()] == [("a", "c", "x")]


def test_traversal_stops_after_two_hops(spark):
    df = note_rows(spark, [("a", {"weight": 0.8}), ("b", {"weight": 0.6}), ("c", {"weight": 0.5}), ("d", {"weight": 0.9}), ("low", {"weight": 0.01})])
    edges = spark.createDataFrame([("a", "b", "relates_to"), ("b", "c", "relates_to"), ("c", "d", "relates_to"), ("a", "low", "depends_on"), ("a", "nowhere", "relates_to")], "source string, target string, edge_type string")
    seeds = spark.createDataFrame([("q", "a", 1)], "query_id string, id string, seed_pos int")
    got = {r.id: (r.hop, r.rank) for r in graph.traverse(seeds, df, edges, AS_OF).collect()}
    assert got == {"a": (0, 1), "b": (1, 2), "c": (2, 3)}


def test_link_effects(spark):
    df = note_rows(spark, [("a", {}), ("b", {"relates_to": ["a"]}), ("c", {})])
    asked = spark.createDataFrame([("a", "b", "relates_to"), ("a", "c", "depends_on"), ("a", "a", "relates_to"), ("a", "zz", "relates_to"), ("a", "c", "odd")], "source string, target string, link_type string")
    assert {tuple(r) for r in graph.apply_links(df, asked).collect()} == {("a", "relates_to", "b"), ("a", "depends_on", "c"), ("c", "blocks", "a")}
    left = changes.unlink(df, asked.filter("link_type = 'relates_to'"))
    assert left.collect() == []


def test_shared_terms_meet_without_hot_tag(spark):
    rows = [(f"n{i}", "hot") for i in range(40)] + [(n, t) for n in ("n1", "n2") for t in ("x", "y")] + [("n3", "x"), (None, "x"), ("n3", None)]
    df = spark.createDataFrame(rows, "id string, term string")
    assert [tuple(r) for r in notes.shared_term_pairs(df, 3).collect()] == [("n1", "n2", 3)]
    assert {tuple(r)[:2] for r in notes.shared_term_pairs(df.filter("term <> 'hot'"), 1).collect()} == {("n1", "n2"), ("n1", "n3"), ("n2", "n3")}


def test_bm25(spark):
    docs = spark.createDataFrame([("m1", "oauth login token flow"), ("m2", "oauth token refresh flow"), ("m3", "docker build cache"), ("m4", ""), ("m5", None)], "id string, text string")
    index = retrieval.build_index(docs)
    assert index.n_docs == 5 and index.avg_len == pytest.approx(11 / 5)
    queries = spark.createDataFrame([("q", "oauth token"), ("none", "absent")], "query_id string, text string")
    assert [(r.query_id, r.id) for r in retrieval.search(index, queries).orderBy("rank").collect()] == [("q", "m1"), ("q", "m2")]
    assert {(r.src, r.id) for r in retrieval.similar(index, min_score=0.1).collect()} == {("m1", "m2"), ("m2", "m1")}
    assert retrieval.build_index(docs.limit(0)).n_docs == 0


@pytest.mark.parametrize("n,want", [(0, (0.3, 0.15)), (50, (2.0, 1.0)), (1, (0.3, 0.15))])
def test_thresholds(n, want):
    got = retrieval.thresholds(n)
    assert got == pytest.approx(want) if n != 1 else got[0] < 1.0


def test_chunks(spark):
    text = "intro\n# One\nalpha beta\n\n#Two\n" + "w " * 500
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x = 1\ndef f():\n  pass\nclass A:\n  pass")], "id int, text string")
    got = [(r.id, r.idx, r.heading) for r in chunks.heading_chunks(docs).orderBy("id", "idx").collect()]
    assert got[:4] == [(1, 0, ""), (1, 1, "One"), (1, 2, "Two"), (1, 3, "Two")]
    assert [(r.idx, r.heading) for r in chunks.function_chunks(docs).filter("id = 4").orderBy("idx").collect()] == [(0, ""), (1, "def f():"), (2, "class A:")]
    small = chunks.sliding_chunks(spark.createDataFrame([(1, " ".join(map(str, range(200))))], "id int, text string"), Chunking(100, 20))
    parts = [r.text.split() for r in small.orderBy("idx").collect()]
    assert [len(p) for p in parts] == [76, 76, 76, 17] and parts[1][0] == "61"
    assert chunks.sliding_chunks(docs.filter("id in (2, 3)")).collect() == []


def test_vote_and_lenses(spark):
    rows = [("tag", "add", ["b", "a"], [], "", "low", "short", "l1"), ("tag", "add", ["a", "b"], ["t"], "", "high", "longer text", "l2"), ("tag", "drop", ["a"], [], "", "low", "x", "l1")]
    df = spark.createDataFrame(rows, "kind string, action string, sources array<string>, targets array<string>, link_type string, severity string, rationale string, lens string")
    got = review.vote(df, 3).collect()
    assert len(got) == 1 and (got[0].votes, got[0].severity, got[0].sources, got[0].targets) == (2, "high", "a,b", "t")
    assert got[0].rationale == "[2/3 runs agreed] longer text" and got[0].agreement == pytest.approx(2 / 3)
    assert [(r.key, r.lenses) for r in review.cross_lens(df).collect()] == [("tag|add|a,b", "l1,l2")]


def test_feedback_stats(spark):
    rows = [("link", 0.8, True, True, 0.1), ("link", 0.6, True, True, -0.05), ("old", 0.5, True, False, 0.1), ("new", 0.5, False, None, None)]
    got = {r.kind: r for r in logs.feedback_stats(spark.createDataFrame(rows, "kind string, confidence double, checked boolean, persisted boolean, delta double")).collect()}
    assert (got["link"].total, got["link"].persisted, got["old"].reverted, got["new"].checked) == (2, 2, 1, 0)
    assert got["link"].avg_delta == pytest.approx(0.025) and got["link"].positive_pct == 50


def test_patch_weight_and_toggle(spark):
    df = spark.createDataFrame([("a", "active", 0.98), ("b", "active", 0.1)], "id string, status string, weight double")
    patch = spark.createDataFrame([("a", "archived", None), ("b", "active", 0.3), ("zz", "active", 0.1)], "id string, status string, weight double")
    got = {r.id: (r.status, r.weight, r.status_changed_at) for r in changes.apply_patch(df, patch, AS_OF).collect()}
    assert got == {"a": ("archived", 0.98, NOW), "b": ("active", 0.3, None)}
    assert [r.w for r in df.select(changes.adjusted_weight(F.lit("useful")).alias("w")).collect()] == [1.0, pytest.approx(0.15)]
    lists = spark.createDataFrame([(["x", "y"], [True]), (["x"], None), ([], None)], "acceptance array<string>, acceptance_met array<boolean>")
    assert [r.m for r in lists.select(changes.toggled(F.lit(2)).alias("m")).collect()] == [[True, True], [False], []]
