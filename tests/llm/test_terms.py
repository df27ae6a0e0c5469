"""n-gram counts against a plain count."""

import random
from collections import Counter, defaultdict

import pytest

from notegraph.llm import queries, terms
from tests.conftest import DATA

SCHEMA = "field string, record string, pos int, token string, n int, c string"


def brute(rows):
    line = defaultdict(dict)
    for f, r, p, t in set(rows):
        if r is not None and t:
            line[f, r, p] = t
    occurrences, records = Counter(), defaultdict(set)
    for f, r, p in line:
        for n in range(1, 1 + sum(1 for x in line if x[:2] == (f, r)) if p is not None else 2):
            keys = [(f, r, p + k) for k in range(n)] if p is not None else [(f, r, p)][: 1 if n == 1 else 0]
            if keys and all(k in line for k in keys):
                gram = (f, n, tuple(line[k] for k in keys))
                occurrences[gram] += 1
                records[gram].add(r)
    return {g: (occurrences[g], len(records[g])) for g in occurrences}


def counted(spark, rows):
    got = terms.ngram_counts(spark.createDataFrame([(*r, 9, "c") for r in rows], SCHEMA)).collect()
    assert len(got) == len({(r.field, r.n, tuple(r.gram)) for r in got})
    return {(r.field, r.n, tuple(r.gram)): (r.occurrences, r.n_records) for r in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_plain_count(spark, seed, monkeypatch):
    monkeypatch.setattr(terms, "_CELLS", 64)
    rng = random.Random(seed)
    rows = []
    for r in range(25):
        field = rng.choice(["tags", "term"])
        for p in range(60 if r == 3 else rng.randrange(12)):
            rows.append((field, f"r{r}", p, rng.choice(["a", "b", "c", "b c", "", None])))
    rows += rows[:30] + [("tags", None, 1, "a"), ("tags", "r1x", None, "a")]
    assert counted(spark, rows) == brute(rows)


def test_one_token_everywhere(spark):
    rows = [("tags", f"r{i}", p, "hot") for i in range(60) for p in range(4)] + [("tags", "r1", 9, "rare")]
    got = counted(spark, rows)
    assert got == brute(rows)
    assert got["tags", 1, ("hot",)] == (240, 60) and got["tags", 3, ("hot", "hot", "hot")] == (120, 60)


def test_marks(spark):
    rows = [("f", f"r{i}", 0, "all") for i in range(40)] + [("f", "r1", 1, "two"), ("f", "r2", 1, "two"), ("f", "r1", 5, "two")]
    rows += [("f", f"r{i}", 2, "edge") for i in range(2, 4)] + [("f", f"r{i}", 3, "three") for i in range(3)]
    df = spark.createDataFrame([(*r, 9, "c") for r in rows], SCHEMA)
    marks = {r.term: r.mark for r in terms.marked_terms(terms.ngram_counts(df), df).collect()}
    assert marks == {"all": "common", "two": "rare", "edge": "rare", "three": "common"}


def test_empty(spark):
    assert counted(spark, []) == {} and counted(spark, [("f", "r", 0, None)]) == {}


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_depth_leaves_out_the_longer_ones_only(spark, depth):
    rows = [("tags", f"r{i % 3}", p, "abcab"[(i + p) % 5]) for i in range(9) for p in range(4 + i % 3)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame([(*r, 9, "c") for r in rows], SCHEMA)
    got = {(r.field, r.n, tuple(r.gram)): (r.occurrences, r.n_records) for r in terms.ngram_counts(df, depth).collect()}
    assert got == {k: v for k, v in brute(rows).items() if k[1] <= depth}


def test_the_longest_gram_is_the_record(spark):
    rows = [("f", "r", p, f"t{p % 7}") for p in range(37)] + [("f", "s", p, f"t{p % 7}") for p in range(37)]
    got = counted(spark, rows)
    assert got == brute(rows) and max(k[1] for k in got) == 37 and got["f", 37, tuple(f"t{p % 7}" for p in range(37))] == (2, 2)


def test_several_tokens_at_one_position(spark):
    got = counted(spark, [("f", "r", 0, "a"), ("f", "r", 1, "c"), ("f", "r", 1, "b"), ("f", "r", 2, "d")])
    assert {k[2] for k in got} == {("a",), ("b",), ("c",), ("d",), ("a", "b"), ("b", "d"), ("a", "b", "d")}


def test_term_marks_come_from_whole_suffixes(spark, monkeypatch):
    longest, suffixes = [], terms.suffixes

    def seen(*args):
        found = suffixes(*args)
        longest.append(found.selectExpr("max(size(suffix))").first()[0])
        return found

    monkeypatch.setattr(terms, "suffixes", seen)
    assert queries.p2_terms(spark, DATA).count() > 0
    tokens = queries.term_tokens(spark, DATA).groupBy("field", "record").count()
    assert longest == [tokens.selectExpr("max(count)").first()[0]]
