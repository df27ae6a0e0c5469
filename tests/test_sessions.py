"""Sessions from the gap tree against a plain loop, with entities spread over more chunks than one merge takes."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators.sessions import gap_tree, sessions_at

SCHEMA = "who string, at bigint, what string, entity string, t string, n int"


def by_loop(rows, gap):
    out = []
    for who in sorted({r[0] for r in rows if None not in r[:3]}):
        times = sorted(r[1] for r in {r[:3] for r in rows if r[0] == who and None not in r[:3]})
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((who, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((who, start, last, n))
    return sorted(out)


def by_tree(spark, rows, gaps, wanted):
    # the columns entity, t and n clash with those the operator works with
    df = spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA)
    tree = gap_tree(df, F.col("who"), F.col("at"), F.col("what"), wanted)
    return {gap: sorted((r.entity, r.start_us, r.end_us, r.n_events) for r in sessions_at(tree, gap).collect()) for gap in gaps}


def make(seed, n, hot=0.4, span=2000):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"a{rng.randrange(9)}", rng.randrange(span), rng.choice("xyz")) for _ in range(n)]


@pytest.mark.parametrize("seed,n,span,chunks", [(1, 400, 2000, 4), (2, 900, 300, 70), (3, 600, 100_000, 40), (4, 50, 5, 8)])
@pytest.mark.parametrize("limited", [True, False])
def test_matches_loop(spark, seed, n, span, chunks, limited):
    rows = make(seed, n, span=span)
    rows += rows[: n // 10] + [(None, 5, "x"), ("a1", None, "x"), ("a1", 7, None)]
    gaps = [0, 1, 7, 30, 1000, span * 10]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", chunks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_tree(spark, rows, gaps, gaps if limited else None)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for gap in gaps:
        assert got[gap] == by_loop(rows, gap), gap


def test_growing_and_equal_gaps(spark):
    rows = [("up", k * k, "x") for k in range(200)] + [("down", -k * k, "x") for k in range(200)] + [("even", 10 * k, "x") for k in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_tree(spark, rows, [9, 10, 11, 100, 399], None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for gap, sessions in got.items():
        assert sessions == by_loop(rows, gap)


def test_empty(spark):
    assert by_tree(spark, [], [5], None) == {5: []}
    assert by_tree(spark, [(None, None, None)], [5], [5]) == {5: []}


def test_pieces_of_a_long_run():
    """The chunk builder taking a run in small pieces gives the same nodes as one tree."""
    import numpy as np

    from notegraph.operators import sessions

    rng = np.random.default_rng(5)
    times = np.cumsum(rng.integers(0, 50, 3000)).tolist()
    atoms = [(t, t, 1, 0) for t in dict.fromkeys(times)]
    whole: list[tuple] = []
    whole.append((*sessions._tree(atoms, whole), sessions._NO_GAP))
    cut: list[tuple] = []
    skeleton = [x for a in range(0, len(atoms), 97) for x in sessions._skeleton(atoms[a : a + 97], True, True, cut)]
    cut.append((*sessions._tree(skeleton, cut), sessions._NO_GAP))
    assert sorted(cut) == sorted(whole)


def test_chunks_follow_the_rows_and_long_runs_are_closed_in_pieces(spark, monkeypatch):
    from notegraph.operators import sessions

    monkeypatch.setattr(sessions, "CHUNK_ROWS", 60)
    monkeypatch.setattr(sessions, "PIECE", 16)
    rows = make(11, 700, hot=0.7, span=4000)
    for gap, got in by_tree(spark, rows, [0, 3, 40], None).items():
        assert got == by_loop(rows, gap)
