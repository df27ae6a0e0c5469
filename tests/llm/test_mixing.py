"""Mixing: exact plans, means of the drawn copies, caps, determinism."""

import numpy as np
import pytest

from notegraph.llm import mixing


@pytest.mark.parametrize("rate,cap", [(0.3, 1), (0.9, 1), (1.7, 2), (0.5, 8), (4.0, 5), (7.9, 8), (0.001, 3)])
def test_truncated_mean(rate, cap):
    below = np.array(mixing.truncated_poisson(rate, cap))
    assert len(below) == cap and (np.diff(below) >= 0).all()
    assert (1 - below).sum() == pytest.approx(rate, rel=1e-6)


def test_bounds():
    assert mixing.truncated_poisson(3, 3) == [0.0] * 3 and mixing.truncated_poisson(0, 2) == [1.0] * 2 and mixing.truncated_poisson(1.0, 0) == []


def tables(spark, docs, targets):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, source string, size bigint, n_copies string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.sized(d, d["size"]), t


def test_shares_caps_and_unreachable(spark):
    docs = [(i, " Big " if i % 2 else "BIG", 10) for i in range(6000)] + [(10_000 + i, "mid", 10) for i in range(3000)]
    docs += [(20_000 + i, "tiny", 10) for i in range(10)] + [(30_000 + i, "unlisted", 10) for i in range(50)] + [(40_000, None, 10), (40_001, "mid", None)]
    targets = [("big", 0.3, 3), ("mid", 0.5, 4), ("tiny", 0.1, 2), ("absent", 0.1, 5), (None, 0.5, 1)]
    sizes, t = tables(spark, docs, targets)
    plan = mixing.mix_plan(sizes, t)
    rows = {r.source: r for r in plan.collect()}
    assert set(rows) == {"big", "mid", "tiny", "absent"} and rows["big"].total == 90_100
    assert [rows[s].reachable for s in ("big", "mid", "tiny", "absent")] == [True, True, False, False]
    drawn = mixing.draw(sizes, plan)
    report = {r.source: r for r in mixing.mix_report(drawn, plan).collect()}
    assert report["tiny"].mix_size == 200 and report["tiny"].most_copies == 2 and report["absent"].mix_size == 0
    assert report["mid"].share_of_total == pytest.approx(0.5, abs=0.02) and report["big"].share_of_total == pytest.approx(0.3, abs=0.02)
    assert all(r.most_copies <= r.max_repeats for r in report.values())
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    once = [tuple(r) for r in mixing.mix(drawn).collect()]
    again = [tuple(r) for r in mixing.mix(mixing.draw(sizes.repartition(7), plan)).collect()]
    assert once == again and len(once) == len({x[:3] for x in once}) and [x[3] for x in once] == sorted(x[3] for x in once)
    assert not any(x[1] == "unlisted" for x in once)
    many = mixing.BROADCAST_SOURCES
    try:
        mixing.BROADCAST_SOURCES = 0
        salted = mixing.draw(sizes, plan)
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, drawn.collect()))
    finally:
        mixing.BROADCAST_SOURCES = many


def test_empty(spark):
    sizes, t = tables(spark, [], [("a", 1.0, 2)])
    plan = mixing.mix_plan(sizes, t)
    assert mixing.mix(mixing.draw(sizes, plan)).collect() == []
    assert [r.mix_size for r in mixing.mix_report(mixing.draw(sizes, plan), plan).collect()] == [0]
    sizes, t = tables(spark, [(1, "a", 5)], [])
    plan = mixing.mix_plan(sizes, t)
    assert plan.collect() == [] and mixing.mix(mixing.draw(sizes, plan)).collect() == []


def test_short_sources_come_from_the_draw(spark):
    docs = [(i, "big", 10) for i in range(500)] + [(1000 + i, "tiny", 10) for i in range(3)] + [(2000, "exact", 50), (3000, "zero", None)]
    targets = [("big", 0.5, 2), ("tiny", 0.1, 2), ("exact", 100 / 5080, 2), ("zero", 0.1, 9), ("absent", 0.1, 2), ("none", 0.0, 2)]
    sizes, t = tables(spark, docs, targets)
    plan = mixing.mix_plan(sizes, t)
    drawn = mixing.draw(sizes, plan)
    got = {r.source: r.mix_size for r in mixing.short_sources(drawn, plan).collect()}
    assert got == {"tiny": 60, "zero": 0, "absent": 0}
    assert set(got) == {r.source for r in plan.filter("not reachable").collect()}
    # a draw in which documents lack copies is no proof that a source is short
    fewer = drawn.withColumn("n_copies", drawn["n_copies"] - (drawn["doc_id"] == 1000).cast("int"))
    assert "tiny" not in {r.source for r in mixing.short_sources(fewer, plan).collect()}


def test_wide_plans_are_not_broadcast(spark, monkeypatch):
    sizes, t = tables(spark, [(i, "a", 1) for i in range(50)], [("a", 1.0, 5)])
    plan = mixing.mix_plan(sizes, t)
    small = sorted(map(tuple, mixing.draw(sizes, plan).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 64)
    assert sorted(map(tuple, mixing.draw(sizes, plan).collect())) == small
