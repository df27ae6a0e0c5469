"""Pair counts against a plain count."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from notegraph.llm import cooccurrence


def brute(rows, least):
    sets = {}
    for k, items in rows:
        if k is not None:
            sets.setdefault(k, set()).update(x.strip(" \t\r\n").lower() for x in items or [] if x is not None and x.strip(" \t\r\n"))
    sets = {k: s for k, s in sets.items() if s}
    single = Counter(x for s in sets.values() for x in s)
    pairs = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    return {p: (n, single[p[0]], single[p[1]], len(sets)) for p, n in pairs.items() if n >= least}


def counted(spark, rows, least=1):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "key string, tags array<string>, items string, n int")
    got = cooccurrence.pair_counts(cooccurrence.baskets(df, F.col("key"), F.col("tags")), least).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    for r in got:
        assert r.lift == pytest.approx(r.ab * r.n_baskets / (r.count_a * r.count_b))
    return {(r.a, r.b): (r.ab, r.count_a, r.count_b, r.n_baskets) for r in got}


@pytest.mark.parametrize("seed,heavy,block,least", [(1, 512, 1024, 1), (2, 8, 1024, 2), (3, 1, 5, 1), (4, 20, 3, 3)])
def test_matches_plain_count(spark, seed, heavy, block, least, monkeypatch):
    monkeypatch.setattr(cooccurrence, "MAX_HEAVY", heavy)
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = random.Random(seed)
    names = ["Top", " big ", "mid\t"] + [f"t{i}" for i in range(40)] + ["ß", "zé", "Zé", "", "  ", None]
    weights = [300, 150, 80] + [60 // (i + 1) + 1 for i in range(40)] + [5, 5, 5, 9, 9, 9]
    rows = [(f"k{rng.randrange(150)}", rng.choices(names, weights, k=rng.randrange(9)) if rng.random() < 0.95 else None) for _ in range(250)]
    rows += rows[:20] + [(None, ["a", "b"]), ("wide", [f"t{i}" for i in range(40)] + ["top"])]
    assert counted(spark, rows, least) == brute(rows, least)


def test_one_pair_in_a_third_of_all(spark):
    rows = [(f"k{i}", ["x", "y"] if i % 3 == 0 else [f"u{i}", f"v{i}"]) for i in range(900)]
    assert counted(spark, rows, 2) == {("x", "y"): (300, 300, 300, 900)}


def test_empty(spark):
    assert counted(spark, []) == {} and counted(spark, [("a", []), ("b", None), ("c", ["", None])]) == {} and counted(spark, [("a", ["x"])]) == {}


def test_a_basket_with_most_of_all_items(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 64)
    wide = [f"w{i}" for i in range(900)]
    rows = [("hot", wide[i : i + 300]) for i in range(0, 900, 150)] + [(f"k{i}", [f"w{i}", f"w{i + 1}", "w7"]) for i in range(0, 400, 2)]
    assert counted(spark, rows, 2) == brute(rows, 2)
    lists = cooccurrence.baskets(spark.createDataFrame(rows, "key string, tags array<string>"), F.col("key"), F.col("tags")).collect()
    assert max(len(r["items"]) for r in lists) <= 64 and len({r.piece for r in lists}) == len(lists)
