"""Hierarchies and cycle members against plain walks."""

import random

import pytest

from notegraph.operators.components import connected_components
from notegraph.operators.hierarchy import CYCLE, cycle_members, descendants, hierarchy


def walked(nodes, parent):
    out = {}
    for x in nodes:
        path, at = [x], x
        while at in parent and parent[at] in nodes and parent[at] not in path:
            at = parent[at]
            path.append(at)
        cyclic = at in parent and parent[at] in nodes
        out[x] = (CYCLE, -1, None) if cyclic else (at, len(path) - 1, "/".join(reversed(path)))
    return out


def run(spark, nodes, links, with_paths=True):
    n = spark.createDataFrame([(x, 1) for x in nodes], "id string, path int")
    e = spark.createDataFrame([(*x, "q") for x in links], "id string, parent string, root_id string")
    rows = hierarchy(e, n, with_paths).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.root_id, r.depth, r.path if with_paths else None) for r in rows}


def forest(seed, n, chain):
    rng = random.Random(seed)
    parent = {f"n{i}": f"n{i - 1 if rng.random() < chain else rng.randrange(i)}" for i in range(1, n) if rng.random() < 0.97}
    parent["n7"] = "n3" if "n3" in parent else "missing"
    for k in range(3):  # cycles of one, two and some nodes, with what hangs below them
        parent[f"c{k}"] = f"c{(k + 1) % 3}"
    parent |= {"s": "s", "t": "u", "u": "t", "below": "c1", "n9": "s", "lost": "missing"}
    return parent


@pytest.mark.parametrize("seed,n,chain", [(1, 120, 0.3), (2, 150, 0.95), (3, 60, 0.0)])
def test_matches_walk(spark, seed, n, chain):
    parent = forest(seed, n, chain)
    nodes = {f"n{i}" for i in range(n)} | {x for x in parent} | {"alone"}
    links = list(parent.items()) + [("n1", parent.get("n1")), ("n2", None), (None, "n1"), ("n3", ""), ("ghost", "n1")]
    spaced = [(f" {a}\t" if a else a, f"\n{b} " if b else b) for a, b in links]
    want = walked(nodes, parent)
    assert run(spark, nodes, spaced + spaced[:20]) == want
    short = run(spark, nodes, spaced, with_paths=False)
    assert short == {k: (v[0], v[1], None) for k, v in want.items()}


def test_one_parent_has_most_children(spark):
    parent = {f"k{i}": "top" for i in range(500)} | {"top": "root"}
    want = walked(set(parent) | {"root"}, parent)
    assert run(spark, set(parent) | {"root"}, list(parent.items())) == want


def test_descendants(spark):
    paths = spark.createDataFrame([("a", "a"), ("b", "a/b"), ("c", "a/b/c"), ("x", None)], "id string, path string")
    assert sorted(map(tuple, descendants(paths).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, ["a", "b"], []) == {"a": ("a", 0, "a"), "b": ("b", 0, "b")}


def reaching_themselves(nodes, edges):
    out = set()
    for x in nodes:
        seen, todo = set(), [x]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b in nodes and b not in seen:
                    seen.add(b)
                    todo.append(b)
        if x in seen:
            out.add(x)
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 30, 25), (2, 40, 60), (3, 25, 80), (4, 60, 55), (5, 12, 40)])
def test_cycle_members(spark, seed, n, m):
    rng = random.Random(seed)
    nodes = {f"v{i}" for i in range(n)}
    edges = {(f"v{rng.randrange(n)}", f"v{rng.randrange(n + 1)}") for _ in range(m)}  # one end is no node
    edges |= {(f"v{i}", f"v{(i + 1) % 6}") for i in range(6)} if seed % 2 else set()
    rows = [(a, f" {b}", 1) for a, b in edges] + [("v1", None, 1), (None, "v2", 1), ("v3", "", 1)] + [(a, b, 2) for a, b in list(edges)[:5]]
    found = cycle_members(
        spark.createDataFrame(rows, "source string, target string, id int"), spark.createDataFrame([(x,) for x in nodes], "id string")
    ).collect()
    assert {r.id for r in found} == reaching_themselves(nodes, edges)
    assert len(found) == len({r.id for r in found})


def test_no_edges(spark):
    edges = spark.createDataFrame([], "source string, target string")
    assert cycle_members(edges, spark.createDataFrame([("a",)], "id string")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(f"v{rng.randrange(60):02}", f"v{rng.randrange(60):02}") for _ in range(45)] + [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    group = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    rows = links + [(None, "v01"), ("v02", None)] + links[:9]
    got = connected_components(spark.createDataFrame(rows, "a string, b string")).collect()
    assert {r.node: r.component for r in got} == group and len(got) == len(group)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([("a", "a")], "a string, b string")).collect() == []


def test_ids_with_slashes(spark):
    parent = {"a/b": "top", "c": "a/b", "d%2F": "c", "e": "d%2F"}
    got = run(spark, [*parent, "top", "x/y"], list(parent.items()))
    assert got["e"] == ("top", 4, "top/a%2Fb/c/d%252F/e") and got["x/y"] == ("x/y", 0, "x%2Fy")
    n = spark.createDataFrame([(x,) for x in [*parent, "top"]], "id string")
    below = descendants(hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), n, True)).collect()
    assert {(r.ancestor, r.descendant) for r in below if r.descendant == "e"} == {("top", "e"), ("a/b", "e"), ("c", "e"), ("d%2F", "e")}
    assert {(r.ancestor, r.distance) for r in below if r.descendant == "d%2F"} == {("top", 3), ("a/b", 2), ("c", 1)}


def test_a_wide_core_takes_few_rounds(spark, monkeypatch):
    from notegraph.operators import hierarchy as module

    n = 10_000
    rounds = []
    whole = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: (rounds.append(label), whole(df, label))[1])
    ring = spark.range(n).selectExpr("concat('v', id) as source", f"explode(array(concat('v', (id + 1) % {n}), concat('v', (id + 7) % {n}))) as target")
    tail = spark.range(20).selectExpr("concat('v', id) as source", "concat('w', id) as target")  # leads out, never back
    nodes = spark.range(n).selectExpr("concat('v', id) as id").unionByName(spark.range(20).selectExpr("concat('w', id) as id"))
    found = cycle_members(ring.unionByName(tail), nodes)
    assert found.count() == n and found.filter("id like 'w%'").count() == 0
    assert len(rounds) < 120  # step by step it would be 1,429 for each direction
