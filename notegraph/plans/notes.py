"""Queries over the notes: filters, data quality, tags, activity, links and changes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import scoring as sc
from notegraph.functions import text as tx
from notegraph.operators import graph, notes as ops
from notegraph.operators.notes import view
from notegraph.operators.order import beside, numbered
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, LINKS, NOTES
from notegraph.sources.tables import table


def _stamp(name: str):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss")


def f01_list(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "type", "status", "tags", "weight", where="type = 'decision' and status = 'active'")
    return ops.list_notes(notes, kind="decision", status="active", tag="backend").select("id", "weight")


def f02_stale(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "type", "last_accessed").filter(ops.not_seen_for(60, AS_OF)).select("id", "type")


def f05_pulse(spark: SparkSession, folder: str) -> DataFrame:
    live = view(spark, folder, "weight", where="type = 'task' and status = 'active'")
    return live.select("id", "weight").orderBy(F.desc("weight"), "id")


def f07_note_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose enumerated values, weight or id are not valid, with each problem."""
    notes = view(spark, folder, "type", "status", "origin", "size", "weight")

    def outside(name: str, allowed: tuple[str, ...]):
        return F.when(F.col(name).isNotNull() & ~F.col(name).isin(*allowed), F.lit(name))

    checks = F.array(
        outside("type", schema.TYPES), outside("status", schema.STATUSES), outside("origin", schema.ORIGINS), outside("size", schema.SIZES),
        F.when(~F.col("weight").between(0.0, 1.0), F.lit("weight")), F.when(tx.name_problem(F.col("id")).isNotNull(), F.lit("id")),
    )
    return notes.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def f09_tag_problems(spark: SparkSession, folder: str) -> DataFrame:
    tags = table(spark, folder, "notes").select("id", F.explode("tags").alias("tag")).filter("tag is not null").distinct()
    return tags.withColumn("problem", tx.tag_problem(F.col("tag"))).filter("problem is not null")


def f08_name_problems(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("source").alias("name")).distinct()
    return names.withColumn("problem", F.coalesce(tx.name_problem(F.col("name")), F.lit("ok")))


def f10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", F.array_join(tx.secrets(F.col("text"), schema.BLOCKING_PATTERNS), "; ").alias("blocked"),
        F.array_join(tx.secrets(F.col("text"), schema.WARNING_PATTERNS), "; ").alias("warnings"),
    )


def f12_visible_characters(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "body").select("id", tx.visible_characters(F.col("body")).cast("bigint").alias("n_chars"))


def f17_long_bodies(spark: SparkSession, folder: str) -> DataFrame:
    words = F.size(tx.fields(F.col("body"))).cast("bigint")
    return view(spark, folder, "body", where="status = 'active'").select("id", words.alias("n_words")).filter("n_words > 100")


def f18_uncrystallized(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "status", "source_issue")
    done = notes.filter("status in ('completed', 'archived')").select("id", "status")
    return done.join(notes.select(F.col("source_issue").alias("id")).filter("id is not null"), "id", "left_anti")


def f20_signal(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "access_count", "created_at", where="status = 'active' and access_count >= 5 and created_at is not null")
    rate = F.col("access_count") / F.greatest(sc.age_days(F.col("created_at"), AS_OF), F.lit(1)).cast("double")
    return notes.select("id", F.round(rate, 6).alias("rate")).filter("rate > 0.5")


def f21_decay_risk(spark: SparkSession, folder: str) -> DataFrame:
    heavy = "status = 'active' and weight >= 0.7 and last_accessed is not null"
    notes = view(spark, folder, "status", "weight", "origin", "type", "last_accessed", "access_count", where=heavy)
    found = ops.decay_risk(notes, AS_OF, replace(schema.SCORING, min_threshold=0.6))
    return found.select("id", "weight", "recency_factor", F.round("score", 6).alias("score"), F.round("score_gap", 6).alias("score_gap"))


def f22_decay_preview(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "last_accessed", where="status = 'active'")
    return notes.select("id", sc.recency(sc.age_days(F.col("last_accessed"), AS_OF)).alias("factor")).filter("factor <= 0.7")


def a01_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tag_counts(view(spark, folder, "tags"))


def a02_concept_counts(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "tags", "body")
    terms = graph.body_links(notes).filter("edge_type = 'concept_ref'").select(F.col("target").alias("tag"))
    both = notes.select(F.explode("tags").alias("tag")).unionByName(terms)
    return both.groupBy(F.col("tag").alias("term")).agg(F.count("*").alias("n"))


def a03_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "type", "status").rollup("type", "status").agg(F.count("*").alias("n"))


def a04_access_distribution(spark: SparkSession, folder: str) -> DataFrame:
    days = sc.age_days(F.col("last_accessed"), AS_OF)
    within = [F.count(F.when(days <= limit, 1)).alias(f"within_{limit}") for limit in (20, 30, 60)]
    return view(spark, folder, "type", "last_accessed").groupBy("type").agg(*within, F.count(F.when(F.col("last_accessed").isNull(), 1)).alias("never"))


def a05_flow(spark: SparkSession, folder: str) -> DataFrame:
    return ops.flow(view(spark, folder, "created_at", "last_accessed"), AS_OF, (20, 40, 60, 90))


def a11_overloaded_tags(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tag_counts(view(spark, folder, "tags")).filter("n > 15")


def a12_tag_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = ops.tag_audit(view(spark, folder, "tags", "status"))
    return audit.select("tag", "n", F.round("specificity", 6).alias("specificity"), "status")


def a14_companions(spark: SparkSession, folder: str) -> DataFrame:
    return ops.companions(view(spark, folder, "tags"))


def a33_progress(spark: SparkSession, folder: str) -> DataFrame:
    return ops.progress(view(spark, folder, "parent", "status", "acceptance", "acceptance_met"))


def a36_scopes(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, *schema.LINK_TYPES)
    links = graph.links_in(notes).select("id", tx.scope_of(F.col("target")).alias("scope"))
    return links.groupBy("scope").agg(F.count("*").alias("n_links"), F.countDistinct("id").alias("n_sources"))


def x07_wiki_links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.body_links(view(spark, folder, "body"))


def x13_recency(spark: SparkSession, folder: str) -> DataFrame:
    days = sc.age_days(F.col("last_accessed"), AS_OF)
    return view(spark, folder, "last_accessed").select("id", days.alias("days"), sc.recency(days).alias("factor"))


def _specificity(notes: DataFrame) -> DataFrame:
    """id, matched: mean specificity of a note's own tags, from the tags' counts."""
    per_tag = ops.tag_counts(notes).select("tag", sc.specificity(F.col("n")).alias("s"))
    return notes.select("id", F.explode("tags").alias("tag")).join(per_tag, "tag").groupBy("id").agg(F.avg("s").alias("matched"))


def x14_tag_specificity(spark: SparkSession, folder: str) -> DataFrame:
    return _specificity(view(spark, folder, "tags")).select("id", F.round("matched", 6).alias("specificity"))


def x15_score(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "tags", "weight", "status", "origin", "type", "access_count", "last_accessed")
    scored = notes.join(_specificity(notes), "id", "left").withColumn("matched", F.coalesce("matched", F.lit(0.0)))
    return scored.select("id", F.round(sc.relevance(F.lit(""), F.col("matched"), F.lit(0), AS_OF), 6).alias("score"))


def w05_next_in_line(spark: SparkSession, folder: str) -> DataFrame:
    """Each note's rank within its type by weight, and the note that would take its place."""
    notes = view(spark, folder, "type", "weight").filter("type is not null")
    line = numbered(notes, ["type"], [F.desc_nulls_last("weight"), F.col("id")], "rank")
    return beside(line, ["type"], 1, {"id": "next_id"}, "rank").select("id", "type", F.col("rank").cast("int").alias("rank"), "next_id")


def x35_checklists(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.inline(tx.checklist(F.col("text"))))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count(F.when(F.col("done"), 1)).alias("n_done"))


def x39_scope(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder).groupBy(tx.scope_of(F.col("id")).alias("scope")).agg(F.count("*").alias("n"))


def j04_isolated(spark: SparkSession, folder: str) -> DataFrame:
    return graph.isolated(view(spark, folder), graph.live_edges(table(spark, folder, "edges")))


def j06_shared_tags(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "tags", where="status <> 'deprecated'")
    return ops.shared_term_pairs(notes.select("id", F.explode("tags").alias("term")))


def j06_shared_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Unlinked pairs with three tags or concepts in common; j06_shared_tags has those by tags alone, linked or not."""
    return ops.link_candidates(view(spark, folder, "status", "tags"), graph.live_edges(table(spark, folder, "edges")))


def j10_broken_links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.broken_links(view(spark, folder, *schema.LINK_TYPES))


def j11_dead_links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.without_dead_links(view(spark, folder, *schema.LINK_TYPES))


def j12_deprecated_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "status", "depends_on")
    links = notes.filter(F.col("status").isin(*schema.LIVE)).select("id", F.explode("depends_on").alias("target")).distinct()
    return links.join(notes.filter("status = 'deprecated'").select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")


def j13_orphaned_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dangling(graph.live_edges(table(spark, folder, "edges")), view(spark, folder))


def j14_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return graph.contradictions(view(spark, folder, "status", "contradicts"))


def j19_concept_index(spark: SparkSession, folder: str) -> DataFrame:
    refs = graph.live_edges(table(spark, folder, "edges")).filter("edge_type = 'concept_ref'")
    return refs.groupBy(F.col("target").alias("term")).agg(F.countDistinct("source").alias("n_notes"), F.min("source").alias("first_note"))


def j21_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between the notes and a snapshot of them in which weights were raised and finished notes reopened."""
    new = view(spark, folder, "status", "title", "weight").withColumn("weight", F.round("weight", 3))
    status = F.when(F.col("status") == "completed", "active").otherwise(F.col("status"))
    old = new.select("id", status.alias("status"), "title", F.when(F.col("weight") < 0.2, F.lit(0.2)).otherwise(F.col("weight")).alias("weight"))
    changes = ops.field_changes(old, new, ("status", "title", "weight"))
    return changes.groupBy("field", "new").agg(F.count("*").alias("n")).filter("field <> 'weight'").unionByName(
        changes.filter("field = 'weight'").groupBy("field").agg(F.count("*").alias("n")).select("field", F.lit("").alias("new"), "n")
    )


def g01_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.edges_of(view(spark, folder, *schema.LINK_TYPES, "parent", "body"))
    return edges.groupBy("source", "target", "edge_type").agg(F.count("*").alias("n"))


def s10_live_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.live_edges(table(spark, folder, "edges"))


def g03_ready(spark: SparkSession, folder: str) -> DataFrame:
    return graph.ready(view(spark, folder, "type", "status", "depends_on"))


def g07_levels(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "depends_on")
    return graph.levels(notes.select(F.col("id").alias("source"), F.explode("depends_on").alias("target")))


def g12_link_effects(spark: SparkSession, folder: str) -> DataFrame:
    """What linking every note to its parent with relates_to, and to its source issue with depends_on, would add."""
    notes = view(spark, folder, *schema.LINK_TYPES, "parent", "source_issue")
    asked = notes.select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("relates_to").alias("link_type")).unionByName(
        notes.select(F.col("id").alias("source"), F.col("source_issue").alias("target"), F.lit("depends_on").alias("link_type"))
    )
    return graph.apply_links(notes, asked.filter("target is not null"))


def g16_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degree_summary(graph.live_edges(table(spark, folder, "edges")))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "acfgjswx" and k[1:3].isdigit()}

_IN = {name: f"({q.words(values)})" for name, values in (("type", schema.TYPES), ("status", schema.STATUSES), ("origin", schema.ORIGINS), ("size", schema.SIZES))}
_NAME_PROBLEM = f"""case when coalesce(name, '') = '' then 'empty' when strlen(name) > 100 then 'too long' when contains(name, '..') then 'path traversal'
  when regexp_matches(name, '[/\\\\]') then 'path separator' when regexp_matches(name, '[\\x00\\r\\n\\t]') then 'control character'
  when upper(name) in ({q.words(schema.RESERVED_NAMES)}) then 'reserved' when not regexp_matches(name, '{schema.NAME_PATTERN}') then 'invalid character' end"""
_COUNTS = "counts as (select tag, count(*) as n from (select unnest(tags) as tag from n) group by tag)"
_BODY_LINKS = f"""found as (select id as source, unnest(list_distinct(list_filter(regexp_extract_all(body, '{schema.WIKI_LINK}', 1), lambda x: x <> id))) as target from n),
body_links as (select source, target, case when target in (select id from n) then 'body_ref' else 'concept_ref' end as edge_type from found)"""
_LIVE_EDGES = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_SCOPE = "case when instr({0}, '-') > 1 then split_part({0}, '-', 1) else '' end"
MATCHED_SQL = f"""{_COUNTS}, own as (select id, unnest(tags) as tag from n),
matched as (select id, avg(1.0::double / log2(counts.n + 2)) as matched from own join counts using (tag) group by id)"""


def secret_list(patterns: tuple) -> str:
    parts = ", ".join("case when regexp_matches(coalesce(text, ''), '" + p.replace("'", "''") + f"') then '{d}' end" for p, d in patterns)
    return f"array_to_string(list_filter([{parts}], lambda x: x is not null), '; ')"


SQL = {
    "f01_list": f"with {NOTES} select id, weight from n where type = 'decision' and status = 'active' and list_contains(tags, 'backend')",
    "f02_stale": f"with {NOTES} select id, type from n where last_accessed is null or last_accessed <= timestamp '{AS_OF}' - interval 60 days",
    "f05_pulse": f"with {NOTES} select id, weight from n where type = 'task' and status = 'active'",
    "f07_note_problems": f"""with {NOTES}, x as (select *, id as name from n)
{' union all '.join(f"select id, '{k}' as problem from x where {k} is not null and {k} not in {v}" for k, v in _IN.items())}
union all select id, 'weight' from x where not (weight between 0.0 and 1.0) union all select id, 'id' from x where {_NAME_PROBLEM} is not null""",
    "f08_name_problems": f"select name, coalesce({_NAME_PROBLEM}, 'ok') as problem from (select distinct source as name from documents)",
    "f09_tag_problems": f"""select * from (select id, tag, case when tag = '' then 'empty' when strlen(tag) > 100 then 'too long'
  when not regexp_matches(tag, '{schema.NAME_PATTERN}') then 'invalid character' end as problem
  from (select distinct id, unnest(tags) as tag from notes) where tag is not null) where problem is not null""",
    "f10_secret_scan": f"select doc_id, {secret_list(schema.BLOCKING_PATTERNS)} as blocked, {secret_list(schema.WARNING_PATTERNS)} as warnings from documents",
    "f12_visible_characters": rf"with {NOTES} select id, length(regexp_replace(body, '[ \t\n\r\x0B\f]', '', 'g'))::bigint as n_chars from n",
    "f17_long_bodies": f"with {NOTES} select id, len({q.fields('body')})::bigint as n_words from n where status = 'active' and len({q.fields('body')}) > 100",
    "f18_uncrystallized": f"with {NOTES} select id, status from n where status in ('completed', 'archived') and id not in (select source_issue from n where source_issue is not null)",
    "f20_signal": f"""with {NOTES} select * from (select id, round(access_count / greatest({q.days('created_at')}, 1)::double, 6) as rate
  from n where status = 'active' and access_count >= 5 and created_at is not null) where rate > 0.5""",
    "f21_decay_risk": f"""with {NOTES}, x as (select id, weight, {q.recency('last_accessed')} as recency_factor,
  (weight + least(access_count * 0.03::double, 0.15::double) + {q.lookup('origin', schema.SALIENCE)} + (case when type = 'explore' then 0.1 else 0.0 end)::double)
    * {q.recency('last_accessed')} as score, {q.days('last_accessed')} as d from n
  where status = 'active' and weight >= 0.7 and (origin = 'failure' or type = 'explore') and last_accessed is not null)
select id, weight, recency_factor, round(score, 6) as score, round(score - 0.6::double, 6) as score_gap from x
where d >= 30 and d < 90 and score - 0.6::double >= 0 and score - 0.6::double <= 0.1::double""",
    "f22_decay_preview": f"with {NOTES} select id, {q.recency('last_accessed')} as factor from n where status = 'active' and {q.recency('last_accessed')} <= 0.7",
    "a01_tag_counts": f"with {NOTES}, {_COUNTS} select tag, n from counts",
    "a02_concept_counts": f"""with {NOTES}, {_BODY_LINKS} select term, count(*) as n from (select unnest(tags) as term from n
  union all select target from body_links where edge_type = 'concept_ref') group by term""",
    "a03_status_counts": f"with {NOTES} select type, status, count(*) as n from n group by rollup(type, status)",
    "a04_access_distribution": f"""with {NOTES} select type, {', '.join(f"count(*) filter ({q.days('last_accessed')} <= {k}) as within_{k}" for k in (20, 30, 60))},
  count(*) filter (last_accessed is null) as never from n group by type""",
    "a05_flow": f"""with {NOTES}, w as (select unnest([20, 40, 60, 90])::int as days) select days, count(*) filter ({q.days('created_at')} < days) as created,
  count(*) filter ({q.days('last_accessed')} < days) as seen from n cross join w group by days""",
    "a11_overloaded_tags": f"with {NOTES}, {_COUNTS} select tag, n from counts where n > 15",
    "a12_tag_audit": f"""with {NOTES}, x as (select tag, count(*) as n, bool_and(status in ('deprecated', 'archived')) as gone
  from (select status, unnest(tags) as tag from n) group by tag)
select tag, n, round(1.0::double / log2(n + 2), 6) as specificity,
  case when gone then 'orphaned' when n > 15 then 'overloaded' when n = 1 then 'unique' else 'ok' end as status from x""",
    "a14_companions": f"""with {NOTES}, i as (select distinct id, tag from (select id, unnest(tags) as tag from n)),
c as (select x.tag, y.tag as other, count(*) as n from i x join i y on x.id = y.id and x.tag <> y.tag group by all)
select * from (select tag, other, n, (row_number() over (partition by tag order by n desc, other))::int as rank from c) where rank <= 3""",
    "a33_progress": f"""with {NOTES} select parent, count(*) as children, count(*) filter (status in ('completed', 'archived')) as done,
  sum(len(acceptance))::bigint as criteria, sum(len(list_filter(coalesce(acceptance_met, []), lambda x: x)))::bigint as met
  from n where parent is not null group by parent""",
    "a36_scopes": f"with {NOTES}, {LINKS} select {_SCOPE.format('target')} as scope, count(*) as n_links, count(distinct id) as n_sources from links group by 1",
    "x07_wiki_links": f"with {NOTES}, {_BODY_LINKS} select * from body_links",
    "x13_recency": f"with {NOTES} select id, {q.days('last_accessed')} as days, {q.recency('last_accessed')} as factor from n",
    "x14_tag_specificity": f"with {NOTES}, {MATCHED_SQL} select id, round(matched, 6) as specificity from matched",
    "x15_score": f"with {NOTES}, {MATCHED_SQL} select n.id, round({q.relevance(chr(39) * 2, 'coalesce(matched, 0.0::double)', '0')}, 6) as score from n left join matched using (id)",
    "w05_next_in_line": f"""with {NOTES} select id, type, (row_number() over w)::int as rank, lead(id) over w as next_id from n where type is not null
  window w as (partition by type order by weight desc nulls last, id)""",
    "x35_checklists": r"""with x as (select doc_id, regexp_extract_all(coalesce(text, ''), '(?m)^- \[([ xX])\] (.+)$', 1) as m from documents)
select doc_id, len(m)::bigint as n_items, len(list_filter(m, lambda v: lower(v) = 'x'))::bigint as n_done from x where len(m) > 0""",
    "x39_scope": f"with {NOTES} select {_SCOPE.format('id')} as scope, count(*) as n from n group by 1",
    "j04_isolated": f"with {NOTES}, {_LIVE_EDGES} select id from n where id not in (select source from le) and id not in (select target from le)",
    "j06_shared_tags": f"""with {NOTES}, i as (select distinct id, tag from (select id, unnest(tags) as tag from n where status <> 'deprecated'))
select x.id as a, y.id as b, count(*)::int as n_shared from i x join i y on x.tag = y.tag and x.id < y.id group by all having count(*) >= 3""",
    "j06_shared_terms": f"""with {NOTES}, le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false))),
i as (select distinct id, term from (select id, unnest(tags) as term from n where coalesce(status, '') <> 'deprecated' union all select source, target from le where edge_type = 'concept_ref')
  where id is not null and term is not null)
select x.id as a, y.id as b, count(*)::int as n_shared from i x join i y on x.term = y.term and x.id < y.id
where not exists (select 1 from le where le.source = x.id and le.target = y.id) group by all having count(*) >= 3""",
    "j10_broken_links": f"""with {NOTES}, {LINKS}, own as (select distinct {_SCOPE.format('id')} as scope from n)
select distinct id, link_type, target, case when {_SCOPE.format('target')} in (select scope from own) then 'broken_link' else 'cross_project_ref' end as problem
from links where target not in (select id from n)""",
    "j11_dead_links": f"""with {NOTES}, {LINKS} select id, link_type, coalesce(string_agg(target, ',' order by pos) filter (target in (select id from n)), '') as kept,
  count(*) filter (target not in (select id from n)) as dropped from links group by id, link_type""",
    "j12_deprecated_dependencies": f"""with {NOTES} select distinct x.id, x.target from (select id, unnest(depends_on) as target from n where status in ('active', 'in_progress')) x
  join n t on t.id = x.target where t.status = 'deprecated'""",
    "j13_orphaned_edges": f"""with {NOTES}, {_LIVE_EDGES}, x as (select *, source in (select id from n) as s, target in (select id from n) as t from le where edge_type <> 'concept_ref')
select source, target, edge_type, case when not s and not t then 'both' when not s then 'source' else 'target' end as missing from x where not (s and t)""",
    "j14_contradictions": f"""with {NOTES}, l as (select * from n where status not in ('deprecated', 'archived'))
select distinct least(id, other) as a, greatest(id, other) as b from (select id, unnest(contradicts) as other from l) where id <> other and other in (select id from l)""",
    "j19_concept_index": f"with {_LIVE_EDGES} select target as term, count(distinct source) as n_notes, min(source) as first_note from le where edge_type = 'concept_ref' group by target",
    "j21_changes": f"""with {NOTES} select 'status' as field, status as new, count(*) as n from n where status = 'completed' group by status
union all select 'weight', '', count(*) from n where round(weight, 3) < 0.2 having count(*) > 0""",
    "g01_edges": f"""with {NOTES}, {LINKS}, {_BODY_LINKS}, e as (select id as source, target, link_type as edge_type from links
  union all select target, id, 'built_by_ref' from links where link_type = 'builds_on' union all select id, parent, 'child_of' from n where parent is not null
  union all select parent, id, 'parent_of' from n where parent is not null union all select source, target, edge_type from body_links)
select source, target, edge_type, count(*) as n from e group by all""",
    "s10_live_edges": f"with {_LIVE_EDGES} select * from le",
    "g03_ready": f"""with recursive {NOTES}, dep as (select distinct id, unnest(depends_on) as target from n),
blocked(id) as (select dep.id from dep left join n t on t.id = dep.target where t.id is null or t.status in ('active', 'in_progress')
  union select dep.id from dep join blocked on dep.target = blocked.id)
select id from n where type = 'task' and status = 'active' and id not in (select id from blocked)""",
    "g07_levels": f"""with recursive {NOTES}, e as (select distinct id as s, unnest(depends_on) as t from n),
l(node, level) as (select distinct s, 0::bigint from e where s not in (select t from e) union select e.t, l.level + 1 from l join e on e.s = l.node where l.level < (select count(*) from e))
select node, min(level)::bigint as level from l group by node""",
    "g12_link_effects": f"""with {NOTES}, {LINKS}, asked as (select id as source, parent as target, 'relates_to' as link_type from n union select id, source_issue, 'depends_on' from n),
valid as (select * from asked where source <> target and target in (select id from n)),
both_sides as (select source as id, link_type, target from valid union select target, case link_type when 'depends_on' then 'blocks' else link_type end, source from valid)
select b.* from both_sides b where not exists (select 1 from links l where l.id = b.id and l.link_type = b.link_type and l.target = b.target)""",
    "g16_degrees": f"""with {_LIVE_EDGES}, k as (select edge_type, source, count(*) as k from le group by all)
select edge_type, sum(k)::bigint as n, count(*) as sources, max(k) as most, any_value(targets) as targets
from k join (select edge_type, count(distinct target) as targets from le group by edge_type) using (edge_type) group by edge_type""",
}
