"""Further queries: summaries of the collection, searches over filtered notes, chains of links and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import scoring as sc
from notegraph.functions import text as tx
from notegraph.operators import graph, logs, notes as ops, retrieval
from notegraph.operators.hierarchy import cycle_members, hierarchy
from notegraph.operators.notes import view
from notegraph.operators.order import beside, numbered
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import LINKS, NOTES
from notegraph.scratch import materialize
from notegraph.sources.tables import folded, table


def a06_out_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Mean number of live edges that leave a note, by type; notes without any count as 0."""
    degree = graph.live_edges(table(spark, folder, "edges")).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    rows = view(spark, folder, "type").join(degree, "id", "left").groupBy("type")
    return rows.agg(F.count("*").alias("notes"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("avg_out"), F.max(F.coalesce("n", F.lit(0))).alias("most"))


def a07_overall_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    days = logs.hit_rates(table(spark, folder, "access_log"))
    return days.agg(F.sum("primed_count").alias("primed"), F.sum("hit_count").alias("hits"), F.round(F.sum("hit_count") / F.sum("primed_count"), 6).alias("rate"))


def a13_orphaned_tags(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tag_audit(view(spark, folder, "tags", "status")).filter("status = 'orphaned'").select("tag", "n")


def a15_tag_carriers(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "tags").select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def a16_density(spark: SparkSession, folder: str) -> DataFrame:
    """Share of tags on one note only, and mean number of links of a note."""
    notes = view(spark, folder, "tags", *schema.LINK_TYPES)
    tags = ops.tag_counts(notes).agg(F.lit("tags").alias("what"), F.count("*").alias("n"), F.round(100 * F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 6).alias("value"))
    size = sum((F.size(t) for t in schema.LINK_TYPES), F.lit(0))
    return tags.unionByName(notes.agg(F.lit("links").alias("what"), F.count("*").alias("n"), F.round(F.avg(size), 6).alias("value")))


def a18_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of notes in force on at least three notes, with their hub note, the smallest constellation that carries the tag."""
    notes = view(spark, folder, "type", "status", "tags")
    rows = notes.filter("status <> 'deprecated'").select("id", "type", F.explode(F.array_distinct("tags")).alias("tag"))
    hub = F.min(F.when(F.col("type") == "constellation", F.col("id")))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), hub.alias("hub")).filter("n >= 3")


def a20_hub_growth(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that at least 30 percent more notes carry now than before the last week of January."""
    rows = view(spark, folder, "tags", "created_at").filter("created_at is not null").select("created_at", F.explode("tags").alias("tag"))
    before = F.count(F.when(F.col("created_at") < F.expr("timestamp_ntz'2017-01-25 00:00:00'"), 1))
    grown = rows.groupBy("tag").agg(before.alias("old"), F.count("*").alias("new")).filter("old > 0")
    return grown.withColumn("growth", F.round((F.col("new") - F.col("old")) / F.col("old") * 100, 6)).filter("growth >= 30")


def a24_summary_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags on at least five completed notes that no context note builds on; pairs are formed within a note."""
    notes = view(spark, folder, "type", "status", "tags", "builds_on")
    summed = notes.filter("type = 'context'").select(F.explode("builds_on").alias("id")).distinct()
    open_ = notes.filter("status = 'completed'").join(summed, "id", "left_anti").select("id", F.array_distinct("tags").alias("tags"))
    pairs = open_.select(F.explode("tags").alias("a"), "tags").select("a", F.explode("tags").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 5")


def a30_last_events(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user and type, by time and id."""
    events = table(spark, folder, "events")
    return events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


def a37_index_summary(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "tags", *schema.LINK_TYPES, "parent", "body")
    parts = [("notes", notes), ("edges", graph.edges_of(notes)), ("tags", ops.tag_counts(notes))]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def f04_children(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "parent", "title")
    return notes.filter("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"), "title").join(view(spark, folder), "id", "left_semi")


def g04_directly_ready(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of which no direct dependency is active; missing ones do not block here."""
    notes = view(spark, folder, "type", "status", "depends_on")
    active = notes.filter("status = 'active'").select(F.col("id").alias("target"))
    held = notes.select("id", F.explode("depends_on").alias("target")).join(active, "target", "left_semi").select("id")
    return notes.filter("type = 'task' and status = 'active'").select("id").join(held, "id", "left_anti")


def g08_cycle_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that can reach themselves over depends_on, builds_on or caused_by."""
    notes = view(spark, folder, "depends_on", "builds_on", "caused_by")
    edges = notes.select(F.col("id").alias("source"), F.explode(F.concat("depends_on", "builds_on", "caused_by")).alias("target"))
    return cycle_members(edges, notes.select("id"))


def g10_widths(spark: SparkSession, folder: str) -> DataFrame:
    """How many notes stand at each level of the dependency graph."""
    notes = view(spark, folder, "depends_on")
    levels = graph.levels(notes.select(F.col("id").alias("source"), F.explode("depends_on").alias("target")))
    return levels.groupBy("level").agg(F.count("*").alias("n"))


def l07_most_accessed(spark: SparkSession, folder: str) -> DataFrame:
    counts = logs.access_counts(table(spark, folder, "access_log")).select("mote_id", "n")
    return counts.orderBy(F.desc("n"), "mote_id").limit(5)


def r05_note_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best active notes for every concept term, from an index over the active notes alone."""
    notes = view(spark, folder, "title", "body", where="status = 'active'")
    docs = notes.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")).alias("text"))
    terms = table(spark, folder, "concept_entries").select(folded(F.col("term")).alias("text")).filter("text <> ''").distinct()
    found = retrieval.search(retrieval.build_index(docs), terms.select(F.col("text").alias("query_id"), "text"), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def r05_reference_search(spark: SparkSession, folder: str) -> DataFrame:
    """r05_note_search over texts that also hold provider and id of the notes' external references."""
    notes = view(spark, folder, "title", "body", "external_refs", where="status = 'active'")
    docs = notes.select("id", ops.search_text().alias("text"))
    terms = table(spark, folder, "concept_entries").select(folded(F.col("term")).alias("text")).filter("text <> ''").distinct()
    found = retrieval.search(retrieval.build_index(docs), terms.select(F.col("text").alias("query_id"), "text"), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def r15_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """For notes with fewer than two tags and wiki links: up to three distinctive terms that would do as tags."""
    notes = view(spark, folder, "status", "title", "body", "tags")
    docs = notes.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")).alias("text"))
    poor = notes.filter(F.col("status").isin(*schema.LIVE)).filter(F.size("tags") + F.size(tx.wiki_links(F.col("body"), F.col("id"))) < 2)
    terms = retrieval.distinctive_terms(retrieval.build_index(docs), 8).join(poor.select("id", "tags"), "id")
    fit = terms.filter(tx.tag_problem(F.col("term")).isNull() & ~F.array_contains("tags", F.col("term")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return fit.withColumn("place", place).filter("place <= 3").select("id", "term", "place")


def s07_replacements(spark: SparkSession, folder: str) -> DataFrame:
    """What finally stands in for each superseded note, and after how many steps; circles have no end."""
    notes = view(spark, folder, "supersedes")
    moved = notes.select(F.col("id").alias("parent"), F.explode("supersedes").alias("id")).groupBy("id").agg(F.min("parent").alias("parent"))
    moved = materialize(moved.join(notes.select("id"), "id", "left_semi"), "moved")
    return hierarchy(moved, notes.select("id")).join(moved.select("id"), "id", "left_semi")


def u06_review_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Which checks each note is due for, from the separate lists of candidates."""
    notes = view(spark, folder, "status", "body", "last_accessed", "tags", "access_count")
    lists = {
        "stale": ops.not_seen_for(45, q.AS_OF), "compress": F.size(tx.fields(F.col("body"))) > 100, "tag": F.size("tags") == 0,
        "signal": F.col("access_count") >= 20,
    }
    due = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in lists.items()]), lambda x: x.isNotNull())
    return notes.filter("status = 'active'").select("id", F.explode(due).alias("task"))


def w02_last_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The last three lines of the edge log of each source."""
    return logs.last_n(table(spark, folder, "edges").select("source", "pos", "target", "edge_type"), "source", "pos", 3)


def w06_edge_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of the edge log with the source's previous target."""
    line = numbered(table(spark, folder, "edges").select("pos", "source", "target"), ["source"], [F.col("pos")], "step")
    return beside(line, ["source"], -1, {"target": "previous"}, "step").select("pos", "source", "previous", F.col("step").cast("int").alias("step"))


def x09_concept_sizes(spark: SparkSession, folder: str) -> DataFrame:
    links = tx.wiki_links(F.col("body"), F.col("id"))
    return view(spark, folder, "tags", "body").select("id", (F.size("tags") + F.size(links)).cast("bigint").alias("n"))


def x20_concept_weights(spark: SparkSession, folder: str) -> DataFrame:
    """For each concept term the number of notes, its weight 1 / log2(n + 2), and whether it tells notes apart."""
    rows = table(spark, folder, "concept_entries").select("mote_id", folded(F.col("term")).alias("term")).filter("term <> ''").distinct()
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    weight = sc.specificity(F.col("n"))
    return counts.select("term", "n", F.round(weight, 6).alias("weight"), (weight > 0.6).alias("distinctive"))


def x29_inferred_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Number of existing tags among the keywords of each title, five at most."""
    notes = view(spark, folder, "title", "tags")
    known = ops.tag_counts(notes).select(F.col("tag").alias("word"))
    words = notes.select("id", F.explode(tx.keywords(F.col("title"))).alias("word")).join(known, "word", "left_semi")
    return words.groupBy("id").agg(F.least(F.count("*"), F.lit(5)).alias("n"))


def x29_tag_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The first five existing tags among the keywords of each title, in their order; x29_inferred_tags counts them."""
    return ops.inferred_tags(view(spark, folder, "title", "tags"))


def x38_references(spark: SparkSession, folder: str) -> DataFrame:
    """External references by provider and project of the address."""
    refs = table(spark, folder, "notes").select("id", F.inline("external_refs").alias("provider", "ref", "url")).distinct()
    project = F.regexp_extract(F.coalesce("url", F.lit("")), r"^https?://[^/]+/([^/]+)/", 1)
    return refs.groupBy("provider", project.alias("project")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_notes"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "afglrsuwx" and k[1:3].isdigit()}

_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_PRIMED = """pd as (select accessed_at::date as day, mote_id, bool_or(coalesce(primed, false)) as primed, bool_or(not coalesce(primed, false)) as hit
  from access_log where mote_id is not null and accessed_at is not null group by all)"""
_WIKI = f"list_distinct(list_filter(regexp_extract_all(body, '{schema.WIKI_LINK}', 1), lambda x: x <> id))"
_LINK_SIZE = " + ".join(f"len({t})" for t in schema.LINK_TYPES)
_TOP = "top as (select *, row_number() over (partition by id order by round(tf * idf, 9) desc, term) as r from p join t using (term))"

SQL = {
    "a06_out_degrees": f"""with {NOTES}, {_LE}, d as (select source as id, count(*) as k from le group by 1)
select type, count(*) as notes, round(avg(coalesce(k, 0)), 6) as avg_out, max(coalesce(k, 0)) as most from n left join d using (id) group by type""",
    "a07_overall_hit_rate": f"""with {_PRIMED} select count(*)::bigint as primed, (count(*) filter (hit))::bigint as hits, round(count(*) filter (hit) / count(*), 6) as rate from pd where primed""",
    "a13_orphaned_tags": f"""with {NOTES} select tag, count(*) as n from (select status, unnest(tags) as tag from n) group by tag having bool_and(status in ('deprecated', 'archived'))""",
    "a15_tag_carriers": f"with {NOTES} select tag, count(distinct id) as n, min(id) as first, max(id) as last from (select id, unnest(tags) as tag from n) group by tag",
    "a16_density": f"""with {NOTES}, c as (select tag, count(*) as k from (select unnest(tags) as tag from n) group by tag)
select 'tags' as what, count(*) as n, round(100 * count(*) filter (k = 1) / count(*), 6) as value from c union all select 'links', count(*), round(avg({_LINK_SIZE}), 6) from n""",
    "a18_hubs": f"""with {NOTES}, x as (select distinct id, type, tag from (select id, type, unnest(tags) as tag from n where status <> 'deprecated'))
select tag, count(*) as n, min(id) filter (type = 'constellation') as hub from x group by tag having count(*) >= 3""",
    "a20_hub_growth": f"""with {NOTES}, c as (select tag, count(*) filter (created_at < timestamp '2017-01-25 00:00:00') as old, count(*) as new
  from (select created_at, unnest(tags) as tag from n where created_at is not null) group by tag)
select tag, old, new, round((new - old) / old * 100, 6) as growth from c where old > 0 and round((new - old) / old * 100, 6) >= 30""",
    "a24_summary_clusters": f"""with {NOTES}, s as (select unnest(builds_on) as id from n where type = 'context'),
i as (select distinct id, tag from (select id, unnest(tags) as tag from n where status = 'completed' and id not in (select id from s)))
select x.tag as a, y.tag as b, count(*) as n from i x join i y on x.id = y.id and x.tag < y.tag group by all having count(*) >= 5""",
    "a30_last_events": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from events group by all",
    "a37_index_summary": f"""with {NOTES}, {LINKS}, b as (select id, unnest({_WIKI}) as t from n)
select 'notes' as what, count(*) as n from n
union all select 'edges', (select count(*) from links) + (select count(*) from links where link_type = 'builds_on') + 2 * (select count(*) from n where parent is not null) + (select count(*) from b)
union all select 'tags', count(distinct tag) from (select unnest(tags) as tag from n)""",
    "f04_children": f"with {NOTES} select p.id, c.id as child, c.title from n c join n p on c.parent = p.id",
    "g04_directly_ready": f"""with {NOTES}, d as (select id, unnest(depends_on) as target from n)
select id from n where type = 'task' and status = 'active' and id not in (select d.id from d join n t on t.id = d.target where t.status = 'active')""",
    "g08_cycle_notes": f"""with recursive {NOTES}, e as (select distinct id as s, t from (select id, unnest(list_concat(list_concat(depends_on, builds_on), caused_by)) as t from n) where t in (select id from n)),
reach(s, t) as (select s, t from e union select r.s, e.t from reach r join e on r.t = e.s) select s as id from reach where s = t""",
    "g10_widths": f"""with recursive {NOTES}, e as (select distinct id as s, unnest(depends_on) as t from n),
l(node, level) as (select distinct s, 0::bigint from e where s not in (select t from e) union select e.t, l.level + 1 from l join e on e.s = l.node where l.level < (select count(*) from e)),
m as (select node, min(level)::bigint as level from l group by node) select level, count(*) as n from m group by level""",
    "l07_most_accessed": "select mote_id, count(*) as n from access_log where mote_id is not null and accessed_at is not null group by 1 order by n desc, mote_id limit 5",
    "r05_note_search": f"""with {NOTES}, {q.bm25("select id, coalesce(title, '') || ' ' || body as text from n where status = 'active'")},
k as (select distinct lower(trim(term, {q.BLANK})) as text from concept_entries where trim(term, {q.BLANK}) <> ''),
a as (select text as query_id, term, count(*) as times from (select text, unnest({q.tokens('text')}) as term from k) group by all),
x as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from a join t using (term) join p using (term) group by all)
select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from x where score > 0) where r <= 5""",
    "r05_reference_search": f"""with {NOTES}, refs as (select distinct on (id) id, external_refs from notes where id is not null order by id),
{q.bm25("select id, coalesce(title, '') || ' ' || body || coalesce(array_to_string(list_transform(external_refs, lambda r: ' ' || coalesce(r.provider, '') || ' ' || coalesce(r.id, '')), ''), '') as text from n join refs using (id) where status = 'active'")},
k as (select distinct lower(trim(term, {q.BLANK})) as text from concept_entries where trim(term, {q.BLANK}) <> ''),
a as (select text as query_id, term, count(*) as times from (select text, unnest({q.tokens('text')}) as term from k) group by all),
x as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from a join t using (term) join p using (term) group by all)
select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from x where score > 0) where r <= 5""",
    "r15_enrichment": f"""with {NOTES}, {q.bm25("select id, coalesce(title, '') || ' ' || body as text from n")}, {_TOP},
poor as (select id, tags from n where status in ('active', 'in_progress') and len(tags) + len({_WIKI}) < 2),
fit as (select top.id, term, row_number() over (partition by top.id order by r)::int as place from top join poor using (id)
  where r <= 8 and strlen(term) <= 100 and not list_contains(tags, term)) select id, term, place from fit where place <= 3""",
    "s07_replacements": f"""with recursive {NOTES}, m as (select id, min(new) as parent from (select unnest(supersedes) as id, id as new from n) where id in (select id from n) group by id),
up as (select n.id, m.parent from n left join m using (id)), walk(id, node, root, depth) as (
  select id, id, id, 0::bigint from up where parent is null union all select c.id, c.id, w.root, w.depth + 1 from walk w join up c on c.parent = w.node)
select m.id, coalesce(root, '(cycle)') as root_id, coalesce(depth, -1) as depth from m left join walk using (id)""",
    "u06_review_tasks": f"""with {NOTES}, a as (select * from n where status = 'active')
select id, 'stale' as task from a where last_accessed is null or last_accessed <= timestamp '{q.AS_OF}' - interval 45 days union all select id, 'compress' from a where len({q.fields('body')}) > 100
union all select id, 'tag' from a where len(tags) = 0 union all select id, 'signal' from a where access_count >= 20""",
    "w02_last_edges": "select source, pos, target, edge_type from edges qualify row_number() over (partition by source order by pos desc) <= 3",
    "w06_edge_chain": "select pos, source, lag(target) over w as previous, (row_number() over w)::int as step from edges window w as (partition by source order by pos)",
    "x09_concept_sizes": f"with {NOTES} select id, (len(tags) + len({_WIKI}))::bigint as n from n",
    "x20_concept_weights": f"""with c as (select term, count(*) as n from (select distinct mote_id, lower(trim(term, {q.BLANK})) as term from concept_entries) where term <> '' group by term)
select term, n, round(1.0::double / log2(n + 2), 6) as weight, 1.0::double / log2(n + 2) > 0.6::double as distinctive from c""",
    "x29_inferred_tags": f"""with {NOTES}, k as (select distinct unnest(tags) as tag from n), w as (select id, unnest({q.keyword_list('title')}) as word from n)
select id, least(count(*), 5) as n from w where word in (select tag from k) group by id""",
    "x38_references": """with r as (select distinct id, x.provider as provider, x.id as ref, x.url as url from (select id, unnest(external_refs) as x from notes))
select provider, regexp_extract(coalesce(url, ''), '^https?://[^/]+/([^/]+)/', 1) as project, count(*) as n, count(distinct id) as n_notes from r group by all""",
}
