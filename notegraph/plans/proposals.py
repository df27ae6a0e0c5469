"""Queries of the review: proposals derived from the notes and the edge log, their scores, effects, batches and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import scoring as sc
from notegraph.functions import text as tx
from notegraph.operators import graph, logs, notes as ops, review
from notegraph.operators.notes import view
from notegraph.plans import notes as note_plans
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, NOTES
from notegraph.scratch import materialize
from notegraph.sources.tables import table

COLUMNS = ("kind", "action", "sources", "targets", "link_type", "rationale", "severity", "tags")
#: Kind: (which notes make such a proposal, its columns in the order of COLUMNS after the kind).
KINDS = {
    "staleness": ("status = 'active' and access_count < 2", "if(weight < 0.6, 'deprecate', 'flag')", "array(id)", "array()", "''", "title", "'low'", "array()"),
    "tag_refinement": ("size(tags) >= 2", "'retag'", "array(id)", "array()", "''", "title", "''", "array_sort(array_distinct(tags))"),
    "compression": ("length(body) > 400", "'compress'", "array(id)", "array()", "''", "left(body, 300)", "'medium'", "array()"),
    "contradiction": ("size(contradicts) > 0", "'link'", "array(id, contradicts[0])", "array()", "''", "title", "'high'", "array()"),
    "constellation": ("type = 'constellation' and size(tags) > 0", "'create'", "concat(array(id), relates_to)", "array()", "''", "title", "'medium'", "slice(tags, 1, 1)"),
    "merge_suggestion": ("size(supersedes) > 0 or size(builds_on) > 1", "'merge'", "array_distinct(concat(array(id), builds_on, supersedes))", "array()", "''", "concat(title, '\\n', body)", "'high'", "tags"),
    "summarize": ("size(depends_on) >= 2 and status = 'completed'", "'summarize'", "array_distinct(concat(array(id), depends_on))", "array()", "''", "concat(title, '\\n', body)", "'medium'", "tags"),
    "action_extraction": ("type = 'lesson' and status = 'active'", "'extract'", "array(id)", "array()", "''", "title", "'low'", "array()"),
    "signal": ("type = 'anchor'", "id", "array(id)", "array()", "''", "title", "'low'", "tags"),
    "link_suggestion": ("size(informed_by) > 0", "'add'", "array(id)", "informed_by", "if(weight > 0.5, 'reinforces', 'relates_to')", "title", "'medium'", "array()"),
    "dominant_mote_review": ("access_count >= 5", "'review'", "array(id)", "array()", "''", "title", "'low'", "array()"),
}


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "type", "status", "title", "weight", "access_count", "body", "tags", *schema.LINK_TYPES)


def _proposals(notes: DataFrame) -> DataFrame:
    """Proposals read off the notes: a note makes one of each kind whose condition it meets."""
    empty = "array()"
    made = [
        F.when(F.expr(test), F.struct(F.lit(kind).alias("kind"), *[F.expr(f"cast({e} as array<string>)" if e == empty else e).alias(c) for c, e in zip(COLUMNS[1:], values)]))
        for kind, (test, *values) in KINDS.items()
    ]
    rows = notes.select("id", "weight", F.explode(F.array_compact(F.array(*made))).alias("p"))
    return rows.select(F.concat_ws(":", "p.kind", "id").alias("pid"), "p.*", F.when(F.col("weight") > 0.5, 1.0).otherwise(0.67).alias("agreement"), F.when(F.col("weight") > 0.4, "depth").otherwise("breadth").alias("lens"))


def f23_valid(spark: SparkSession, folder: str) -> DataFrame:
    return review.valid_proposals(_proposals(_base(spark, folder))).select("pid", "severity")


def x22_structure(spark: SparkSession, folder: str) -> DataFrame:
    return _proposals(_base(spark, folder)).select("pid", F.round(review.structure_score(), 6).alias("structure"))


def r22_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every note with its own tags as matched ones."""
    return note_plans.x15_score(spark, folder)


def x25_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = review.quality(_proposals(_base(spark, folder)), r22_scores(spark, folder))
    return found.select("pid", F.round("quality", 12).alias("quality"))


def _sure(spark: SparkSession, folder: str) -> DataFrame:
    """The proposals with their confidence from history, structure, severity, quality of the notes, and agreement."""
    notes = materialize(_base(spark, folder), "notes")
    rows = materialize(_proposals(notes), "proposals")
    stats = review.persisted(rows, notes, graph.live_edges(table(spark, folder, "edges"))).join(rows.select("pid", "kind"), "pid")
    history = logs.feedback_stats(stats.select("kind", F.lit(0.5).alias("confidence"), F.lit(True).alias("checked"), "persisted", F.when(F.col("persisted"), 0.1).otherwise(-0.2).alias("delta")))
    past = history.select("kind", review.history_score(F.col("total"), F.col("checked"), F.col("persisted"), F.col("positive_pct"), F.col("avg_delta")).alias("history"))
    full = rows.join(past, "kind").join(review.quality(rows, r22_scores(spark, folder)), "pid")
    return full.withColumn("confidence", review.confidence(F.col("history"), review.structure_score(), F.col("severity"), F.col("quality"), F.col("agreement")))


def x24_proposal_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _sure(spark, folder).select("pid", F.round("confidence", 12).alias("confidence"))


def v16_split(spark: SparkSession, folder: str) -> DataFrame:
    """How many proposals of each kind are applied at once and how many wait."""
    rows = _sure(spark, folder).groupBy("kind", (F.round("confidence", 9) >= schema.AUTO_APPLY).alias("applied"))
    return rows.agg(F.count("*").alias("n"))


def v17_effects(spark: SparkSession, folder: str) -> DataFrame:
    """What applying every proposal changes; values as hashes."""
    notes = materialize(_base(spark, folder), "notes")
    found = review.applied_effects(_proposals(notes), notes, graph.live_edges(table(spark, folder, "edges")))
    return found.select("effect", "id", "name", F.md5(F.coalesce("value", F.lit(""))).alias("hash"))


def j20_persisted(spark: SparkSession, folder: str) -> DataFrame:
    notes = materialize(_base(spark, folder), "notes")
    return review.persisted(_proposals(notes), notes, graph.live_edges(table(spark, folder, "edges")))


def v18_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Mean change of the notes' scores since the proposals were applied, when they were a tenth lower for lessons."""
    scores = materialize(r22_scores(spark, folder), "scores")
    before = review.affected(_proposals(_base(spark, folder))).join(scores, "id").join(view(spark, folder, "type"), "id")
    before = before.select("pid", "id", F.when(F.col("type") == "lesson", F.col("score") - 0.1).otherwise(F.col("score")).alias("score"))
    return review.score_deltas(before, scores).select("pid", F.round("delta", 6).alias("delta"))


def v20_run(spark: SparkSession, folder: str) -> DataFrame:
    """The record of a run in which reconciliation keeps the proposals that are not of low severity."""
    rows = _sure(spark, folder).withColumn("confidence", F.round("confidence", 9))
    out = review.run_summary(rows, rows.filter("severity <> 'low'"), 12, 1.5)
    return out.select("batches", "batch_proposals", "proposals", "auto_applied", "deferred", *[F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_agreement", "filter_rate", "cost_per_proposal")])


def v21_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The orders of the first quarter as a ledger whose last row is completed."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("state"))
    return review.rewrite_last(rows, "pos", {"state": F.lit("done"), "config": F.concat("config", F.lit("*"))})


def v22_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates each list has."""
    notes = _base(spark, folder)
    lists = u06_tasks(spark, folder).groupBy("task").agg(F.count("*").alias("n"))
    return lists.unionByName(_proposals(notes).groupBy(F.concat(F.lit("proposal "), "kind").alias("task")).agg(F.count("*").alias("n")))


def a35_lenses(spark: SparkSession, folder: str) -> DataFrame:
    return _proposals(_base(spark, folder)).groupBy("lens").agg(F.count("*").alias("n"))


def v08_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge line as a proposal of the lens of its type, with the lenses that agree on it."""
    log = table(spark, folder, "edges").select(
        "pos", F.lit("link_suggestion").alias("kind"), F.lit("add").alias("action"), F.array("source").alias("sources"), F.array("target").alias("targets"),
        F.when(F.col("edge_type").isin("blocks", "depends_on"), "dependency").otherwise("reference").alias("link_type"), F.col("edge_type").alias("lens"),
    )
    return review.lens_members(log).select("pos", F.array_join("lenses", ",").alias("lenses"))


def u06_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """note and task of the nine lists that the review takes together: pairs by terms and by content, contradictions, stale, long
    and uncrystallized notes, hubs, notes to merge, and signals."""
    notes = view(spark, folder, "type", "status", "body", "last_accessed", "tags", "access_count", "source_issue", "contradicts", "created_at", "supersedes")
    active = notes.filter("status = 'active'")
    edges = graph.live_edges(table(spark, folder, "edges"))

    def named(rows: DataFrame, task: str) -> DataFrame:
        return rows.select("id", F.lit(task).alias("task"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    done = notes.filter("status in ('completed', 'archived')").join(notes.select(F.col("source_issue").alias("id")).filter("id is not null"), "id", "left_anti")
    rate = F.col("access_count") / F.greatest(sc.age_days(F.col("created_at"), AS_OF), F.lit(1)).cast("double")
    merged = notes.select("id", F.explode("supersedes").alias("other")).join(notes.select(F.col("id").alias("other")), "other", "left_semi")
    out = named(ops.in_link_candidates(notes, edges), "link_inference")
    for rows, task in (
        (ends(edges.filter("edge_type = 'relates_to'").select(F.col("source").alias("a"), F.col("target").alias("b"))), "content_link_review"),
        (ends(graph.contradictions(notes)), "contradiction_detection"), (active.filter(ops.not_seen_for(45, AS_OF)), "staleness_evaluation"),
        (active.filter(F.size(tx.fields(F.col("body"))) > 100), "compression"), (done, "crystallization"),
        (notes.filter("type = 'constellation'"), "constellation_evolution"), (merged.select(F.explode(F.array("id", "other")).alias("id")), "merge_review"),
        (active.filter("access_count >= 5 and created_at is not null").filter(rate > 0.5), "signal_discovery"),
    ):
        out = out.unionByName(named(rows, task))
    return out.distinct()


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of the lists of single notes."""
    notes = view(spark, folder, "status", "body", "last_accessed", "access_count", "tags")
    tests = {"staleness": ops.not_seen_for(45, AS_OF), "compression": F.size(tx.fields(F.col("body"))) > 60, "signal": F.col("access_count") >= 3, "tag": F.size("tags") > 2}
    due = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return materialize(notes.select("id", F.explode(due).alias("task")), "tasks")


def v03_batches(spark: SparkSession, folder: str) -> DataFrame:
    return review.batches(_tasks(spark, folder), view(spark, folder, "tags"))


def v04_together(spark: SparkSession, folder: str) -> DataFrame:
    """The batches after the children of each parent are put together."""
    families = view(spark, folder, "parent").filter("parent is not null").select("id", F.col("parent").alias("cluster_id"))
    return review.together(v03_batches(spark, folder), families)


def v05_batch_tasks(spark: SparkSession, folder: str) -> DataFrame:
    tasks = _tasks(spark, folder)
    found = review.batch_tasks(review.batches(tasks, view(spark, folder, "tags")), tasks)
    return found.select("batch", "n", F.array_join("tasks", ",").alias("tasks"))


def l08_first_batches(spark: SparkSession, folder: str) -> DataFrame:
    tasks = _tasks(spark, folder)
    found = review.batch_tasks(review.batches(tasks, view(spark, folder, "tags")), tasks, most=3)
    return found.select("batch", "n", F.array_join("tasks", ",").alias("tasks"))


def l09_tag_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the notes by first tag, the largest first."""
    first = view(spark, folder, "tags").filter(F.size("tags") > 0).groupBy(F.col("tags")[0].alias("tag")).agg(F.count("*").alias("n"))
    return first.orderBy(F.desc("n"), "tag")


def j07_contradiction_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of contradictions as counts: active decisions and lessons that share a tag and of which one has a word that the
    other lacks, by tag and by the sets of such words on both sides. The pairs themselves grow with the square of a tag."""
    return ops.opposed_classes(view(spark, folder, "tags", "body", where="status = 'active' and type in ('decision', 'lesson')"))


def x43_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in prose with proposals in JSON, made of the notes, read back: fenced or bare, with braces inside strings."""
    notes = view(spark, folder, "type", "title", "weight", "tags")
    one = F.to_json(F.struct(F.lit("staleness").alias("type"), F.col("title").alias("rationale"), F.array("id").alias("sources"), F.col("tags").alias("tags")))
    body = F.concat(F.lit('{"proposals": ['), one, F.lit(', {"type": "", "note": "a } or \\" {"}], "n": '), F.size("tags").cast("string"), F.lit("}"))
    prose = F.when(F.col("weight") > 0.5, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone {x}."))).otherwise(F.concat(F.lit("I found "), body, F.lit(" and no more.")))
    answers = notes.select("id", F.when(F.col("type") != "question", prose).otherwise(F.lit("no idea")).alias("text"))
    shape = "struct<proposals: array<struct<type: string, rationale: string, sources: array<string>, tags: array<string>>>, n: int>"
    parsed = answers.select("id", F.from_json(review.json_in(F.col("text")), shape).alias("r"))
    first = F.filter(F.coalesce("r.proposals", F.lit(None)), lambda p: (p["type"] != "") & (F.size(p["sources"]) > 0))
    return parsed.select("id", F.coalesce(F.size(first), F.lit(0)).alias("n_valid"), F.get(first, F.lit(0))["rationale"].alias("rationale"), F.col("r.n").alias("n"))


def x44_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are a string or an object in JSON, as one text; strength 1 where it is only a string."""
    notes = view(spark, folder, "title", "weight", "tags")
    as_text = F.to_json(F.array(F.coalesce("title", F.lit(""))))
    plain = F.expr("substring(_j, 2, length(_j) - 2)")
    obj = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("description"), F.round("weight", 3).alias("strength")))
    rows = notes.withColumn("_j", as_text).withColumn("value", F.when(F.size("tags") > 2, obj).otherwise(plain))
    return rows.select("id", review.said(F.col("value"), "description").alias("description"), F.coalesce(F.get_json_object("value", "$.strength").cast("double"), F.when(F.size("tags") <= 2, 1.0)).alias("strength"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "afjlruvx" and k[1:3].isdigit()}

_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"


def _duck(expression: str) -> str:
    """The few functions of the proposals' expressions as DuckDB writes them."""
    for old, new in (
        ("array_sort(array_distinct(tags))", "list_sort(list_distinct(tags))"), ("array_distinct(concat(array(id), builds_on, supersedes))", "u.m"),
        ("array_distinct(concat(array(id), depends_on))", "u.s"), ("concat(array(id), relates_to)", "list_concat([id], relates_to)"), ("array(id, contradicts[0])", "[id, contradicts[1]]"),
        ("array(id)", "[id]"), ("array()", "[]::varchar[]"), ("slice(tags, 1, 1)", "tags[1:1]"), ("size(", "len("), ("if(", "if("), ("concat(title, '\\n', body)", "title || chr(10) || body"),
    ):
        expression = expression.replace(old, new)
    return expression


def _part(kind: str, test: str, values: list[str]) -> str:
    columns = ", ".join(f"{_duck(v)} as {c}" for c, v in zip(COLUMNS[1:], values))
    return f"select '{kind}:' || id as pid, '{kind}' as kind, {columns}, weight from n, lateral (select list_distinct(list_concat([id], list_concat(builds_on, supersedes))) as m, list_distinct(list_concat([id], depends_on)) as s) u where {_duck(test)}"


_PR = "pr as (select *, case when weight > 0.5 then 1.0::double else 0.67::double end as agreement, case when weight > 0.4 then 'depth' else 'breadth' end as lens from (" + " union all ".join(
    _part(k, v[0], list(v[1:])) for k, v in KINDS.items()
) + "))"
_HAS = "(case when coalesce({0}, '') <> '' then 1.0 else 0.0 end)"
_YES = "(case when {0} then 1.0 else 0.0 end)"
_OWN = {
    "link_suggestion": ([_YES.format("len(sources) > 0"), _YES.format("len(targets) > 0"), _HAS.format("link_type")], 3), "contradiction": ([_YES.format("len(sources) >= 2")], 1),
    "tag_refinement": ([_YES.format("len(sources) > 0"), _YES.format("len(tags) > 0")], 2), "staleness": ([_YES.format("len(sources) > 0")], 1),
    "compression": ([_YES.format("len(sources) > 0"), _YES.format("strlen(coalesce(rationale, '')) > 100")], 2), "signal": ([_HAS.format("action"), _YES.format("len(tags) > 0")], 2),
    "merge_suggestion": ([_YES.format("len(sources) >= 3"), _YES.format("len(tags) > 0"), _YES.format("strlen(coalesce(rationale, '')) > 100")], 3),
}
_GIVEN = " + ".join([_HAS.format("kind"), _HAS.format("action"), _HAS.format("rationale"), "(case when strlen(coalesce(rationale, '')) > 50 then 0.5 else 0.0 end)"])
_STRUCTURE = "(case kind " + " ".join(f"when '{k}' then ({_GIVEN} + {' + '.join(f)}) / {3.5 + t}::double" for k, (f, t) in _OWN.items()) + f" else ({_GIVEN} + {_YES.format('len(sources) > 0')}) / 4.5::double end)::double"
_SCORE = f"""{note_plans.MATCHED_SQL}, sco as (select n.id, round({q.relevance(chr(39) * 2, 'coalesce(matched, 0.0::double)', '0')}, 6) as score from n left join matched using (id))"""
_AFFECTED = "aff as (select distinct pid, id from (select pid, unnest(list_concat(sources, targets)) as id from pr))"
_QUALITY = f"{_AFFECTED}, qual as (select pr.pid, coalesce(greatest(0.0::double, least(1.0::double, avg(score) / 2)), 0.5::double) as quality from pr left join (select pid, score from aff join sco using (id)) x using (pid) group by pr.pid)"
_PERSISTED = """per as (select pid, kind, case when kind in ('link_suggestion', 'contradiction') then exists (select 1 from le where source = sources[1]
    and target = case when kind = 'contradiction' then sources[2] else targets[1] end and edge_type = case when kind = 'contradiction' then 'contradicts' else link_type end)
  when kind = 'staleness' then coalesce(f.status = 'deprecated', false) when kind = 'tag_refinement' then coalesce(len(list_filter(pr.tags, lambda t: not list_contains(f.tags, t))) = 0, false)
  when kind = 'compression' then f.id is not null when kind = 'merge_suggestion' then coalesce(gone.g, true) else true end as persisted
  from pr left join n f on f.id = sources[1] left join (select pid, bool_and(coalesce(n.status = 'deprecated', false)) as g from (select pid, unnest(sources) as id from pr where kind = 'merge_suggestion') x left join n on n.id = x.id group by pid) gone using (pid))"""
_SURE = f"""{_SCORE}, {_LE}, {_PR}, {_QUALITY}, {_PERSISTED},
hist as (select kind, (count(*) filter (persisted) / count(*) + count(*) filter (persisted) / count(*) + greatest(0.0::double, least(1.0::double, avg(case when persisted then 0.1::double else -0.2::double end) + 0.5))) / 3.0 as history from per group by kind),
sure as (select pr.*, greatest(0.0::double, least(1.0::double, history * 0.35::double + {_STRUCTURE} * 0.2::double + (case severity when 'high' then 0.9 when 'medium' then 0.6 when 'low' then 0.3 else 0.5 end)::double * 0.15::double + quality * 0.1::double + agreement * 0.2::double)) as confidence
  from pr join hist using (kind) join qual using (pid))"""
_SINGLE = f"""t as (select id, task from (select id, tags, unnest([case when last_accessed is null or last_accessed <= timestamp '{AS_OF}' - interval 45 days then 'staleness' end,
  case when len({q.fields('body')}) > 60 then 'compression' end, case when access_count >= 3 then 'signal' end, case when len(tags) > 2 then 'tag' end]) as task from n) where task is not null)"""
_BATCHES = f"""{_SINGLE}, ids as (select id, tags[1] as tag from n where id in (select id from t)), k as (select tag, count(*) as k from ids where tag is not null group by tag),
g as (select id, tag, k, row_number() over (order by k desc, tag, id) as g from ids join k using (tag)),
f as (select id, 'clustered' as phase, tag as cluster, (g - min(g) over (partition by tag)) // 50 as part, k, g from g), c as (select * exclude (g) from f where g <= (select floor(count(*) * 0.6::double) from ids)),
rest as (select id, 'interleaved' as phase, '' as cluster, (row_number() over (order by id) - 1) // 50 as part, 0 as k from ids where id not in (select id from c)),
every as (select * from c union all select * from rest), b as (select id, phase, cluster, dense_rank() over (order by phase, k desc, cluster, part)::bigint as batch from every)"""
_MASK = " + ".join(f"(case when contains(lower(body), '{w.replace(chr(39), chr(39) * 2)}') then {1 << i} else 0 end)" for i, w in enumerate(schema.NEGATORS))

SQL = {
    "f23_valid": f"with {NOTES}, {_PR} select pid, coalesce(nullif(severity, ''), 'medium') as severity from pr where coalesce(rationale, '') <> '' and len(sources) > 0",
    "x22_structure": f"with {NOTES}, {_PR} select pid, round({_STRUCTURE}, 6) as structure from pr",
    "r22_scores": f"with {NOTES}, {_SCORE} select * from sco",
    "x25_quality": f"with {NOTES}, {_SCORE}, {_PR}, {_QUALITY} select pid, round(quality, 12) as quality from qual",
    "x24_proposal_confidence": f"with {NOTES}, {_SURE} select pid, round(confidence, 12) as confidence from sure",
    "v16_split": f"with {NOTES}, {_SURE} select kind, round(confidence, 9) >= 0.6::double as applied, count(*) as n from sure group by all",
    "j20_persisted": f"with {NOTES}, {_LE}, {_PR}, {_PERSISTED} select pid, persisted from per",
    "v18_deltas": f"with {NOTES}, {_SCORE}, {_PR}, {_AFFECTED} select pid, round(avg(case when type = 'lesson' then score - (score - 0.1::double) else 0.0::double end), 6) as delta from aff join sco using (id) join n using (id) group by pid",
    "v20_run": f"""with {NOTES}, {_SURE}, x as (select *, round(confidence, 9) as c from sure)
select 12 as batches, count(*) as batch_proposals, count(*) filter (severity <> 'low') as proposals, count(*) filter (severity <> 'low' and c >= 0.6::double) as auto_applied, count(*) filter (severity <> 'low' and c < 0.6::double) as deferred,
  round(avg(c) filter (severity <> 'low'), 6) as avg_confidence, round(avg(agreement) filter (severity <> 'low'), 6) as avg_agreement, round(1 - count(*) filter (severity <> 'low') / count(*), 6) as filter_rate, round(1.5::double / count(*) filter (severity <> 'low'), 6) as cost_per_proposal from x""",
    "v21_ledger": "select o_orderkey as pos, case when o_orderkey = (select max(o_orderkey) from orders) then o_orderpriority || '*' else o_orderpriority end as config, case when o_orderkey = (select max(o_orderkey) from orders) then 'done' else o_orderstatus end as state from orders",
    "a35_lenses": f"with {NOTES}, {_PR} select lens, count(*) as n from pr group by lens",
    "v08_members": """with x as (select pos, edge_type as lens, source || '|' || target || '|' || case when edge_type in ('blocks', 'depends_on') then 'dependency' else 'reference' end as key from edges),
a as (select key, string_agg(distinct lens, ',' order by lens) as lenses from x group by key having count(distinct lens) >= 2) select pos, coalesce(lenses, '') as lenses from x left join a using (key)""",
    "u06_tasks": f"""with {NOTES}, {_LE}, i as (select distinct id, term from (select id, unnest(tags) as term from n where coalesce(status, '') <> 'deprecated' union all select source, target from le where edge_type = 'concept_ref') where id is not null and term is not null),
p as (select x.id as a, y.id as b from i x join i y on x.term = y.term and x.id < y.id where not exists (select 1 from le where le.source = x.id and le.target = y.id) group by all having count(*) >= 3),
l as (select * from n where status not in ('deprecated', 'archived')), k as (select id, other from (select id, unnest(contradicts) as other from l) where id <> other and other in (select id from l)),
m as (select id, other from (select id, unnest(supersedes) as other from n) where other in (select id from n)), act as (select * from n where status = 'active')
select id, 'link_inference' as task from (select a as id from p union select b from p) union select id, 'content_link_review' from (select source as id from le where edge_type = 'relates_to' union select target from le where edge_type = 'relates_to')
union select id, 'contradiction_detection' from (select id from k union select other from k) union select id, 'staleness_evaluation' from act where last_accessed is null or last_accessed <= timestamp '{AS_OF}' - interval 45 days
union select id, 'compression' from act where len({q.fields('body')}) > 100 union select id, 'crystallization' from n where status in ('completed', 'archived') and id not in (select source_issue from n where source_issue is not null)
union select id, 'constellation_evolution' from n where type = 'constellation' union select id, 'merge_review' from (select id from m union select other from m)
union select id, 'signal_discovery' from act where access_count >= 5 and created_at is not null and access_count / greatest({q.days('created_at')}, 1)::double > 0.5""",
    "v03_batches": f"with {NOTES}, {_BATCHES} select * from b",
    "v04_together": f"""with {NOTES}, {_BATCHES}, h as (select b.id, batch, parent from b join n using (id) where parent is not null),
w as (select parent, batch, row_number() over (partition by parent order by count(*) desc, batch) as r from h group by parent, batch)
select b.id, coalesce(w.batch, b.batch) as batch from b left join h using (id) left join w on w.parent = h.parent and w.r = 1""",
    "v05_batch_tasks": f"with {NOTES}, {_BATCHES} select batch, count(distinct b.id) as n, string_agg(distinct task, ',' order by task) as tasks from b join t using (id) group by batch",
    "l08_first_batches": f"with {NOTES}, {_BATCHES} select batch, count(distinct b.id) as n, string_agg(distinct task, ',' order by task) as tasks from b join t using (id) where batch <= 3 group by batch",
    "l09_tag_groups": f"with {NOTES} select tags[1] as tag, count(*) as n from n where len(tags) > 0 group by 1",
    "j07_contradiction_classes": f"""with {NOTES}, x as (select id, {_MASK} as mask, unnest(list_distinct(tags)) as tag from n where status = 'active' and type in ('decision', 'lesson')), c as (select tag, mask, count(*) as k from x group by all)
select a.tag, a.mask::int as mask_a, b.mask::int as mask_b, a.k * b.k as n_pairs from c a join c b on a.tag = b.tag and a.mask < b.mask""",
    "x43_answers": f"""with {NOTES} select id, (case when type = 'question' then 0 else 1 end)::int as n_valid, case when type <> 'question' then title end as rationale, (case when type <> 'question' then len(tags) end)::int as n from n""",
    "x44_patterns": f"with {NOTES} select id, coalesce(title, '') as description, case when len(tags) > 2 then round(weight, 3) else 1.0::double end as strength from n",
}
SQL["v22_dry_run"] = f"""select task, count(*) as n from ({SQL['u06_tasks']}) group by task
union all select 'proposal ' || kind, n from (with {NOTES}, {_PR} select kind, count(*) as n from pr group by kind)"""
