"""Products of sparse rows against plain sums, and what the searches shuffle."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from notegraph import scratch
from notegraph.operators import notes, products, retrieval


def brute(rows, asked, least, k, others):
    held, found = defaultdict(Counter), {}
    for d, terms, weights, part in rows:
        for t, w in zip(terms, weights):
            held[part, d][t] += w
    for q, terms, weights in asked:
        groups = defaultdict(list)
        for (part, d), own in held.items():
            common = [(t, w) for t, w in zip(terms, weights) if t in own]
            score = sum(w * own[t] for t, w in common)
            if common and not (others and q == d) and (least is None or score >= least):
                groups[part].append((-round(score, 9), d))
        for part, scored in groups.items():
            found[q, part] = sorted(scored)[:k]
    return found


@pytest.mark.parametrize("seed, held, cells, dense", [(1, 40, 64, 0.02), (2, 10**6, 200, 0.5), (3, 7, 1 << 19, 0.001), (4, 90, 1, 2.0)])
@pytest.mark.parametrize("k, least, others, signed", [(3, None, False, False), (2, 1.0, True, False), (None, 1.5, False, True), (4, None, True, True)])
def test_matches_plain_sums(tmp_path, monkeypatch, seed, held, cells, dense, k, least, others, signed):
    for name, value in (("_HELD", held), ("_CELLS", cells), ("_DENSE", dense), ("_LISTED", 16), ("_ASKED", 5)):
        monkeypatch.setattr(products, name, value)
    rng = random.Random(seed)

    def some(n):
        terms = [rng.choice("aaaaabbbcdefghijklmnop") for _ in range(n)]
        return terms, [rng.choice([0.25, 0.5, 1.0, *([-0.5, 0.0] if signed else [])]) for _ in terms]

    rows = [(f"n{i}", *some(rng.choice([0, 1, 2, 3, 9])), rng.choice(["x", "y", None])) for i in range(60)]
    asked = [(f"n{i}", *(list(x) for x in zip(*{t: (t, w) for t, w in zip(*some(rng.randrange(1, 6)))}.values()))) for i in range(0, 60, 3)]
    asked.append(("none", ["zz"], [1.0]))
    pq.write_table(pa.table({"query_id": [x[0] for x in asked], "terms": [x[1] for x in asked], "weights": [x[2] for x in asked]}), tmp_path / "part.parquet")
    table = pa.table({"id": [x[0] for x in rows], "terms": pa.array([x[1] for x in rows], pa.list_(pa.string())), "weights": pa.array([x[2] for x in rows], pa.list_(pa.float64())), "part": [x[3] for x in rows]})
    run = products._matched(str(tmp_path), k, least, others, False, ["query_id", "part", "id", "score"])
    got = defaultdict(list)
    for batch in run(iter(table.to_batches(max_chunksize=7))):
        for r in batch.to_pylist():
            got[r["query_id"], r["part"]].append((-round(r["score"], 9), r["id"]))
    want = brute(rows, asked, least, k, others)
    assert {q: sorted(x)[:k] for q, x in got.items()} == want
    assert sum(map(len, got.values())) <= (k or 10**9) * max(1, len(want)) * 60


def matched(tmp_path, rows, asked, k, least, others):
    """The best of each query and part, and how many cells of the matrix were filled."""
    pq.write_table(pa.table({"query_id": [x[0] for x in asked], "terms": [x[1] for x in asked], "weights": [x[2] for x in asked]}), tmp_path / "part.parquet")
    table = pa.table({"id": [x[0] for x in rows], "terms": pa.array([x[1] for x in rows], pa.list_(pa.string())), "weights": pa.array([x[2] for x in rows], pa.list_(pa.float64())), "part": [x[3] for x in rows]})
    got, cells = defaultdict(list), 0
    products_ = products._Share.products

    def counted(self, *args):
        nonlocal cells
        for found in products_(self, *args):
            cells += found[1].size
            yield found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(products._Share, "products", counted)
        for batch in products._matched(str(tmp_path), k, least, others, False, ["query_id", "part", "id", "score"])(iter(table.to_batches())):
            for r in batch.to_pylist():
                got[r["query_id"], r["part"]].append((-round(r["score"], 9), r["id"]))
    return {q: sorted(x)[:k] for q, x in got.items()}, cells


def zipfian(rng, n, size):
    """Terms of which a few are in most rows and most in a few, with weights that repeat or not."""
    terms = [f"t{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(1, size))]
    return terms, [rng.choice([0.5, 1.0, rng.random() + 1e-6]) for _ in terms]


@pytest.mark.parametrize("seed, short, many, listed, bounded", [(1, 32, 0.2, 1 << 19, 1 << 16), (2, 0, 10, 1 << 19, 1 << 16), (3, 0, 10, 8, 16), (4, 3, 0.5, 64, 40)])
@pytest.mark.parametrize("k, least, others, parts", [(3, None, True, [None]), (1, 1.0, False, ["x", "y", None]), (20, None, False, ["x", "y"]), (5, 2.5, True, [None])])
def test_best_without_all_products(tmp_path, monkeypatch, seed, short, many, listed, bounded, k, least, others, parts):
    for name, value in (("_SHORT", short), ("_MANY", many), ("_LISTED", listed), ("_BOUNDED", bounded)):
        monkeypatch.setattr(products, name, value)
    rng = random.Random(seed)
    rows = [(f"n{i:03}", *zipfian(rng, i, 30), rng.choice(parts)) for i in range(300)]
    asked = [(f"n{i:03}", *(list(x) for x in zip(*{t: (t, w) for t, w in zip(*zipfian(rng, i, 9))}.values()))) for i in range(0, 300, 4)]
    got, cells = matched(tmp_path, rows, asked, k, least, others)
    assert got == brute(rows, asked, least, k, others)
    assert many < 1 or cells == 0


def test_rare_terms_fill_no_matrix(tmp_path):
    rows = [(f"n{i:04}", ["all", f"a{i // 3}", f"b{i // 5}"], [0.1, 1.0 + i % 2, 1.0], None) for i in range(3000)]
    got, cells = matched(tmp_path, rows, [(r[0], r[1], [0.01, 2.0, 2.0]) for r in rows], 3, 1.0, True)
    assert len(got) == 3000 and got["n0000", None] == [(-6.001, "n0001"), (-4.001, "n0002"), (-2.001, "n0003")]
    assert cells < 3000 * 3000 / 100


def moved(spark, df):
    """Rows that all stages of the job wrote for shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows = df().collect()
    return rows, total() - before


def test_search_shuffles_no_pairs(spark):
    docs = spark.range(400).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.concat(F.lit("common other"), F.repeat(F.lit(" pad"), (F.col("id") % 7).cast("int"))).alias("text"))
    queries = docs.select(F.col("id").alias("query_id"), F.lit("common other").alias("text"))
    index = retrieval.build_index(docs)
    rows, n = moved(spark, lambda: retrieval.search(index, queries, 3))
    assert len(rows) == 1200 and {r.id for r in rows} == {"d0000", "d0007", "d0014"}
    assert n < 20_000  # a row for each pair were 160,000
    rows, n = moved(spark, lambda: retrieval.similar(index, 2, 0.0))
    assert len(rows) == 800 and n < 20_000


def test_seeds_shuffle_no_pairs(spark):
    found = spark.range(300).select(F.format_string("n%04d", "id").alias("id"), F.array(F.lit("Hot")).alias("tags"), F.lit("Hot matter").alias("title"), F.lit("hot body").alias("body"))
    topics = spark.range(300).select(F.col("id").alias("query_id"), F.lit("hot").alias("text"))
    refs = spark.createDataFrame([("n0005", "hot"), ("gone", "hot")], "source string, target string")
    rows, n = moved(spark, lambda: retrieval.seeds(topics, found, refs, 2))
    assert {(r.id, round(r.strength, 6), r.seed_pos) for r in rows} == {("n0005", 2.3, 1), ("n0000", 1.3, 2)} and len(rows) == 600
    assert n < 20_000  # a row for each pair were 90,000 for tags and as many for words


def test_words_in_titles_shuffle_no_letters(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_WORDS", 2)
    titles = spark.range(500).select("id", F.concat(F.lit("the quiet harbour of lantern "), F.col("id").cast("string")).alias("title"))
    words = spark.createDataFrame([("tern 49",), ("harbour",), ("no",)], "word string")
    rows, n = moved(spark, lambda: retrieval.titles_with(words, titles))
    held = {(r.id, w) for r in rows for w in r.words}
    assert held == {(i, "harbour") for i in range(500)} | {(i, "tern 49") for i in (49, *range(490, 500))}
    assert n < 2_000  # a row for each run of letters were 40,000


def test_link_candidates_shuffle_no_pairs(spark):
    found = spark.range(400).select(F.format_string("n%04d", "id").alias("id"), F.lit("active").alias("status"), F.array(*map(F.lit, "abc")).alias("tags"))
    edges = spark.createDataFrame([("n0000", "n0001", "relates_to"), ("n0003", "n0002", "relates_to")], "source string, target string, edge_type string")
    rows, n = moved(spark, lambda: notes.link_candidates(found, edges))
    pairs = {(r.a, r.b, r.n_shared) for r in rows}
    assert len(rows) == len(pairs) == 400 * 399 // 2 - 1 and ("n0000", "n0001", 3) not in pairs and ("n0002", "n0003", 3) in pairs
    assert n < 20_000
    two = found.filter("id < 'n0002'")
    assert notes.in_link_candidates(two, edges).count() == 0 and notes.in_link_candidates(found, edges).count() == 400


def test_pairs_with_and_without_shared_terms(spark):
    found = spark.createDataFrame([("a", "active", list("xyz")), ("b", "active", list("xyz")), ("c", "active", list("xy")), ("d", "active", [])], "id string, status string, tags array<string>")
    edges = spark.createDataFrame([("c", "z", "concept_ref")], "source string, target string, edge_type string")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3)], "a string, b string, n int")
    assert {tuple(r) for r in notes.without_shared_terms(pairs, found, edges).collect()} == {("a", "d", 3)}
    assert {tuple(r) for r in notes.without_shared_terms(pairs, found, edges.limit(0)).collect()} == {("a", "c", 2), ("a", "d", 3)}


@pytest.mark.parametrize("k, least, others", [(3, None, False), (2, 1.0, True)])
def test_only_the_best_leave_a_task(tmp_path, monkeypatch, k, least, others):
    monkeypatch.setattr(products, "_HELD", 12)
    monkeypatch.setattr(products, "_ASKED", 7)
    rng = random.Random(k)
    rows = [(f"n{i:03}", *zipfian(rng, i, 12), rng.choice(["x", None])) for i in range(120)]
    asked = [(f"n{i:03}", *(list(x) for x in zip(*{t: (t, w) for t, w in zip(*zipfian(rng, i, 6))}.values()))) for i in range(0, 120, 3)]
    pq.write_table(pa.table({"query_id": [x[0] for x in asked], "terms": [x[1] for x in asked], "weights": [x[2] for x in asked]}), tmp_path / "part.parquet")
    table = pa.table({"id": [x[0] for x in rows], "terms": [x[1] for x in rows], "weights": [x[2] for x in rows], "part": pa.array([x[3] for x in rows], pa.string())})
    got = defaultdict(list)
    for at in range(3):  # of a third of the asked rows each
        run = products._matched(str(tmp_path), k, least, others, False, ["query_id", "part", "id", "score"], None, (at, 3))
        for batch in run(iter(table.to_batches(max_chunksize=5))):
            for r in batch.to_pylist():
                got[r["query_id"], r["part"]].append((-round(r["score"], 9), r["id"]))
    assert got == brute(rows, asked, least, k, others)


@pytest.mark.parametrize("leaving, stored", [(1, 0), (300_000, 10**7), (10**7, 10**8), (10**8, 10**9)])
def test_what_leaves_all_tasks_is_bounded(leaving, stored):
    groups, asked = products._grid(6, 100, leaving, stored)
    assert groups == 1 or groups * leaving <= products._LEFT + stored / products._LEFT_BYTES
    assert groups * asked >= 6 and leaving / asked <= products._KEPT


def test_shuffles_of_scratch_tables_go_at_once(spark):
    def files():
        root = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
        return {p for p in root.rglob("shuffle_*.data")}

    before = files()
    held = scratch.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and held.count() == 7
    assert spark.conf.get(scratch._CLEANUP) == "false"
