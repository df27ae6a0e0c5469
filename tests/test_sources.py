"""Round trips of files: notes, logs, exports, corpora; streams against batches."""

import json

from notegraph.operators.chunks import heading_chunks
from notegraph.sources import corpus, logs, notes_md
from notegraph.streaming import access


def test_markdown_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nid: p-1\ntype: task\ntitle: 'A title'\ntags: [x, y]\nweight: 0.5\nblocks:\n  - p-2\n  - p-3\ncreated_at: 2024-01-02T03:04:05Z\n---\nBody\n---\nmore")
    (tmp_path / "sub" / "b.md").write_text("---\r\nid: p-2\r\nweight: odd\r\n---\r\nText")
    (tmp_path / "bad.md").write_text("no front matter")
    (tmp_path / "none.md").write_text("---\ntitle: without id\n---\n")
    (tmp_path / "c.txt").write_text("---\nid: p-9\n---\n")
    rows = {r.id: r for r in notes_md.read_notes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"p-1", "p-2"}
    assert rows["p-1"].tags == ["x", "y"] and rows["p-1"].blocks == ["p-2", "p-3"] and rows["p-1"].title == "A title" and rows["p-1"].weight == 0.5
    assert rows["p-1"].body == "Body\n---\nmore" and rows["p-2"].body == "Text" and rows["p-2"].weight is None


def test_logs_skip_bad_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "1.json").write_text('{"mote_id":"a","accessed_at":"2024-01-01T00:00:00Z","primed":true}\nnot json\n{"mote_id":"b"}\n')
    rows = logs.read_log(spark, str(path), logs.LOGS["access"])
    assert sorted(r.mote_id for r in rows.collect()) == ["a", "b"]
    logs.append_log(rows, str(path))
    assert logs.read_log(spark, str(path), logs.LOGS["access"]).count() == 4


def test_export_and_import(spark, tmp_path):
    notes = spark.createDataFrame([("1", "task", "T", "b", ["x"]), ("2", "task", "T", "b", ["y"]), ("3", "lesson", "U", None, [])], "id string, type string, title string, body string, tags array<string>")
    logs.export_notes(notes, str(tmp_path / "out"), kind="task", tag="x")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["1"]
    fresh = logs.new_notes(notes, notes.filter("id = '3'"))
    assert [r.id for r in fresh.collect()] == ["1"]


def test_corpus_refresh(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\ntext")
    (tmp_path / "b.md").write_text("# Two\ntext")
    (tmp_path / "c.bin").write_text("skipped")
    files = corpus.read_corpus(spark, str(tmp_path))
    assert files.count() == 2
    manifest = spark.createDataFrame([(r.path, r.hash) for r in files.collect()], "path string, hash string")
    old = spark.createDataFrame([(r.path, 0, "", "kept") for r in files.collect()], "path string, idx int, heading string, text string")
    (tmp_path / "b.md").write_text("# Two\nchanged")
    (tmp_path / "d.md").write_text("new")
    now = corpus.refresh(old, manifest, corpus.read_corpus(spark, str(tmp_path)), heading_chunks)
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in now.collect()) == [("a.md", "kept"), ("b.md", "# Two\nchanged"), ("d.md", "new")]


def test_index_file(spark, tmp_path):
    notes = spark.createDataFrame([("1", "task", "b title", "# h\n\nfirst line"), ("2", "task", "A title", None), ("3", "lesson", None, "x")], "id string, type string, title string, body string")
    corpus.write_index(notes, str(tmp_path / "index"))
    text = "".join(f.read_text() for f in (tmp_path / "index" / "type=task").glob("*.txt"))
    assert text == "- [A title](nodes/2.md)\n- [b title](nodes/1.md) — first line\n"


def test_replayed_batches_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i % 3}", i) for i in range(90)], "mote_id string, k int").selectExpr("mote_id", "timestamp_seconds(k) as accessed_at")
    rows.repartition(6).write.parquet(str(tmp_path / "access_log.parquet"))
    got = {r.mote_id: r.n for r in access.access_counts(access.stream_of(spark, str(tmp_path), "access_log", 2)).collect()}
    assert got == {"n0": 30, "n1": 30, "n2": 30}


def test_extensions_of_a_corpus(spark, tmp_path):
    names = ["a.css", "b.HTML", "c.xml", "d.py", "e.hpp", "f.tsx", "g.jsx", "h", "i.md"]
    for name in names:
        (tmp_path / name).write_text("x")
    got = {r.path.rsplit("/", 1)[1] for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.css", "b.HTML", "c.xml", "d.py", "i.md"}


def test_front_matter_of_every_shape(spark, tmp_path):
    for name in ("alpha/nodes", "beta/nodes", "beta/trash"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "alpha/nodes/a.md").write_text(
        "---\nid: p-1\ntitle: |\n  two\n  lines\nacceptance:\n  - one\n  - two\nacceptance_met: [true, false]\n"
        "external_refs:\n  - provider: tracker\n    id: 7\n    url: https://x.invalid/7\nweight: [1]\n---\nbody"
    )
    (tmp_path / "alpha/nodes/bad.md").write_text("---\nid: [p-2\ntitle: x: y: z\n---\n")
    (tmp_path / "beta/nodes/b.md").write_text("---\nid: q-1\n---\n")
    (tmp_path / "beta/trash/c.md").write_text("---\nid: q-2\ndeleted_at: 2024-01-02T03:04:05Z\n---\n")
    rows = {r.id: r for r in notes_md.read_notes(spark, str(tmp_path / "alpha"), str(tmp_path / "beta")).collect()}
    assert set(rows) == {"p-1", "q-1", "q-2"}
    one = rows["p-1"]
    assert one.title == "two\nlines\n" and one.acceptance == ["one", "two"] and one.acceptance_met == [True, False] and one.weight is None
    assert [tuple(x) for x in one.external_refs] == [("tracker", "7", "https://x.invalid/7")]
    assert (rows["p-1"].origin_scope, rows["q-1"].origin_scope) == ("alpha", "beta")
    assert [(r.id, r.deleted_at.year) for r in notes_md.read_trash(spark, str(tmp_path / "beta")).collect()] == [("q-2", 2024)]


def test_issues_proposals_and_journal(spark, tmp_path):
    (tmp_path / "issues.jsonl").write_text('{"id":"i1","title":"A","labels":["UI ","not ok"],"priority":2}\n{"id":"i1","title":"A"}\n{"id":"i2","title":" "}\nbroken\n')
    got = logs.read_issues(spark, str(tmp_path / "issues.jsonl")).collect()
    assert [(r.source_issue, r.type) for r in got] == [("i1", "task")]
    (tmp_path / "p.jsonl").write_text('{"type":"signal","source_notes":["a"],"confidence":0.5}\n[1]\n')
    assert [r.source_notes for r in logs.read_log(spark, str(tmp_path / "p.jsonl"), logs.LOGS["proposals"]).collect()] == [["a"]]
    shape = "pattern_id string, description string, strength double, ids array<string>"
    held = spark.createDataFrame([("x", "old", 1.0, ["a"]), ("y", "y", 1.0, [])], shape)
    seen = spark.createDataFrame([("x", "new", 0.5, ["b", "a"]), ("z", "z", 2.0, ["c"])], shape)
    merged = {r.pattern_id: (r.description, r.strength, r.ids) for r in logs.merge_patterns(held, seen).collect()}
    assert merged == {"x": ("old", 1.5, ["a", "b"]), "y": ("y", 1.0, []), "z": ("z", 2.0, ["c"])}
    entries = spark.createDataFrame([(i, "x" * 10) for i in range(40)], "pos int, text string")
    assert sorted(r.pos for r in logs.pruned(entries, 55, 3).collect()) == [35, 36, 37, 38, 39]
    assert sorted(r.pos for r in logs.pruned(entries, 5, 3).collect()) == [37, 38, 39]
