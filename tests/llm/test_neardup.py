"""Near-duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notegraph.llm import neardup, sketch

SCHEMA = "name string, words string, id int, ref int, text string, row int, bucket int"


def grams(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, t):
    sets = {name: grams(text, k) for name, text in rows if name is not None}
    names = sorted(x for x in sets if sets[x])
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def found(spark, rows, k=3, t=0.5, **more):
    df = spark.createDataFrame([(n, x, 1, 2, "clash", 3, 4) for n, x in rows], SCHEMA)
    return neardup.near_duplicates(df, F.col("name"), F.col("words"), k, t, **more)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(3)] = rng.choices(vocabulary, k=rng.randrange(3))
        else:
            words = rng.choices(vocabulary, k=rng.randrange(2, 60))
        out.append((f"n{i:03}", " ".join(words) or "x"))
    return out


@pytest.mark.parametrize("seed,k,t,hot", [(1, 3, 0.5, 2048), (2, 3, 0.5, 2), (3, 5, 0.8, 2048), (4, 1, 0.3, 4), (5, 2, 0.9, 3)])
def test_matches_brute_force(spark, seed, k, t, hot):
    rows = corpus(seed, 120)
    rows += [("copy1", rows[3][1].upper() + " !"), ("copy2", rows[3][1].replace(" ", " - "))]
    got = [tuple(r) for r in found(spark, rows + rows[:9], k, t, hot=hot).pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, k, t)


def test_edge_texts(spark):
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    rows = [("a", None), ("b", ""), ("c", "one two"), ("d", "one two three"), ("e", "One, two; THREE!"), ("f", "ein schöner Tag"), ("g", "EIN SCHÖNER TAG"), ("h", long), ("i", long + " end"), (None, "one two three")]
    assert {tuple(r) for r in found(spark, rows).pairs().collect()} == {("d", "e"), ("f", "g"), ("h", "i")}


def test_copies_in_bulk_and_groups(spark):
    text = "the same note again and again until the end of it"
    rows = [(f"k{i:03}", text) for i in range(60)] + [("near", text + " now"), ("near2", text + " now then"), ("far", "quite another text with other words")]
    similar = found(spark, rows)
    assert len(similar.pairs().collect()) == len(brute(rows, 3, 0.5))
    groups = {r.id: (r.class_id, r.group_id, r.n_links) for r in similar.groups().collect()}
    assert groups["k007"] == ("k000", "k000", 61) and groups["near2"] == ("near2", "k000", 61) and groups["far"] == ("far", "far", 0)
    assert len(groups) == len(rows)


def test_empty(spark):
    similar = found(spark, [])
    assert similar.pairs().collect() == [] and similar.groups().collect() == []


def test_bounds_never_below_overlap():
    rng = np.random.default_rng(1)
    join = neardup.Join(3, 0.5, 1, 16)
    texts = pa.array([" ".join(map(str, rng.integers(0, 90, int(n)))) for n in rng.integers(5, 400, 60)])
    bounds, key = neardup.sorted_sets(texts, 1)
    sets = [key[a:b] for a, b in zip(bounds, bounds[1:])]
    size = np.array([len(s) for s in sets])
    blobs = []
    for s, w in zip(sets, join.widths(size)):
        image = np.zeros(w, dtype=bool)
        image[(neardup._mix(s) & np.uint64(w - 1)).astype(int)] = True
        blobs.append(np.packbits(image, bitorder="little").tobytes())
    x, y = np.triu_indices(len(sets), 1)
    bound = neardup._Bitmaps(np.frombuffer(b"".join(blobs), dtype=np.uint8), join.widths(size)).bound(x, y, size)
    assert all(b >= len(np.intersect1d(sets[i], sets[j])) for b, i, j in zip(bound, x, y))


def test_sketch_is_an_upper_bound(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 5000, 40_000).astype(np.int64)
    df = spark.createDataFrame([(int(k),) for k in keys], "k bigint").repartition(5)
    levels = sketch.build(df, lambda batch: batch.column("k").to_numpy().view(np.uint64), 16)
    value, count = np.unique(keys, return_counts=True)
    assert (sketch.at_most(levels[sketch.bucket(value.view(np.uint64), 16)]) >= count).all()
    assert (levels > 0).sum() <= len(value)


def test_two_texts_of_one_key(spark):
    rows = [("x", "a b c d e"), ("x", "a b c d e f"), ("y", "a b c d e"), ("y", "a b c d e"), ("z", "a b c d e f")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = [tuple(r) for r in neardup.near_duplicates(df, F.col("id"), F.col("text")).pairs().collect()]
    assert sorted(got) == [("x", "y"), ("x", "z"), ("y", "z")]


def test_a_family_is_compared_in_few_cells(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"f{k:03}", " ".join(base[: k % 59] + [f"x{k}"] + base[k % 59 + 1 :])) for k in range(150)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), F.col("id"), F.col("text"))
    assert found.pairs().count() == 150 * 149 // 2
    assert found.class_links().filter("class_a < class_b").count() == 150 * 149 // 2
