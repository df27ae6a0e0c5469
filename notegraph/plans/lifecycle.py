"""Queries of the write path: creation, snapshots, differences, links and their effects, deletion, trash, merging and moving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import changes, graph
from notegraph.operators.notes import view
from notegraph.plans import sqlparts as q
from notegraph.plans.notes import secret_list
from notegraph.plans.sqlparts import AS_OF, LINKS, NOTES
from notegraph.sources.tables import table


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "status", "title", "weight", "tags", "acceptance", *schema.LINK_TYPES, "body")


def m01_create(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as incoming notes: which are accepted, and why others are not."""
    rows = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("kind").alias("type"), F.col("project").alias("title"), F.array("source").alias("tags"),
        F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("origin"), F.lit("").alias("size"), F.col("text").alias("body"),
    )
    return changes.create(rows).select("id", "problem", "status", "weight", "origin", F.col("n_warnings").cast("bigint").alias("n_warnings"))


def m08_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return changes.snapshot(_all(spark, folder), AS_OF).select("id", "snapshot_at", "status", "title", "weight", "tags", "acceptance", "links", "body_hash")


def j21_note_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Fields, links of each type, tags and bodies that differ from a snapshot before the last clean-up of the notes."""
    new = _all(spark, folder)
    old = new.withColumns({
        "status": F.when(F.col("status") == "completed", "active").otherwise(F.col("status")), "tags": F.array_remove("tags", "backend"),
        "depends_on": F.slice("depends_on", 2, 1000), "blocks": F.reverse("blocks"), "body": F.replace("body", F.lit("\r\n"), F.lit("\n")),
        "acceptance": F.concat("acceptance", F.when(F.col("status") == "archived", F.array(F.lit("archived"))).otherwise(F.array().cast("array<string>"))),
    })
    return changes.differences(changes.snapshot(old, AS_OF), changes.snapshot(new, AS_OF))


def g12_all_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Every effect of linking notes to their parents and source issues by four types of links."""
    notes = view(spark, folder, *schema.LINK_TYPES, "parent", "source_issue")
    asked = None
    for end, kind in (("parent", "relates_to"), ("parent", "builds_on"), ("source_issue", "depends_on"), ("source_issue", "supersedes")):
        rows = notes.select(F.col("id").alias("source"), F.col(end).alias("target"), F.lit(kind).alias("link_type")).filter("target is not null")
        asked = rows if asked is None else asked.unionByName(rows)
    return graph.link_effects(notes, asked)


def g15_delete_effects(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "status", *schema.LINK_TYPES)
    return changes.delete_effects(notes, table(spark, folder, "edges"), notes.filter("status = 'deprecated'").select("id"), AS_OF)


def g16_edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that make every relates_to edge hold both ways and end every contradicts edge."""
    log = table(spark, folder, "edges")
    related = log.filter("edge_type = 'relates_to'").select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type")
    return graph.new_edges(log, related).unionByName(graph.tombstones(log, log.filter("edge_type = 'contradicts'")))


def _trash(notes: DataFrame) -> DataFrame:
    return notes.filter("status = 'deprecated'").select("id", F.col("last_accessed").alias("deleted_at"))


def g17_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Asking back all tasks out of the deprecated notes as trash, of which those with a successor are live again."""
    notes = view(spark, folder, "type", "status", "last_accessed", "supersedes")
    again = notes.select(F.explode("supersedes").alias("id")).join(_trash(notes), "id", "left_semi").distinct()
    return changes.restore(_trash(notes), again, notes.filter("type = 'task'"))


def f24_trash(spark: SparkSession, folder: str) -> DataFrame:
    """Which deprecated notes, last seen when they were deleted, have expired, and the days left of the others."""
    return changes.trash_state(_trash(view(spark, folder, "status", "last_accessed")), AS_OF, 35)


def _successors(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("new"), F.explode("supersedes").alias("old")).groupBy("old").agg(F.min("new").alias("new"))


def j22_note_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Parents and bodies after every superseded id is replaced; j22_rewrite has the links."""
    notes = view(spark, folder, "parent", "body", "supersedes")
    return changes.rewrite_notes(notes, _successors(notes)).select("id", "parent", F.md5("body").alias("hash"))


def j23_merged_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links that move to the note that supersedes an end of them."""
    notes = view(spark, folder, "supersedes")
    members = _successors(notes).select(F.col("old").alias("id"), F.col("new").alias("merged"))
    return graph.moved_links(graph.live_edges(table(spark, folder, "edges")), members)


def m10_forwarded(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge notes moved to the shared scope under new ids, with tombstones under the old ones."""
    notes = view(spark, folder, "type", "status")
    moved = notes.filter("type in ('decision', 'lesson', 'explore')").select(F.col("id").alias("old"), F.concat(F.lit("global-"), F.col("id")).alias("new"))
    return changes.forwarded(notes, moved)


def m05_toggle_items(spark: SparkSession, folder: str) -> DataFrame:
    """acceptance_met after toggling each criterion in turn, and after marking all."""
    notes = view(spark, folder, "acceptance", "acceptance_met").filter(F.size("acceptance") > 0)
    rows = notes.select("*", F.explode(F.sequence(F.lit(0), F.size("acceptance"))).alias("item"))
    met = F.when(F.col("item") == 0, F.transform("acceptance", lambda x: F.lit(True))).otherwise(changes.toggled(F.col("item")))
    return rows.select("id", "item", F.array_join(F.transform(met, lambda x: x.cast("string")), ",").alias("met"))


def s08_origin_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of sibling projects seen together: how many each scope has and how many of them lead into another."""
    notes = view(spark, folder, *schema.LINK_TYPES)
    links = graph.links_in(notes).select("id", tx.scope_of(F.col("id")).alias("scope"), tx.scope_of(F.col("target")).alias("other")).filter("scope <> other and other <> ''")
    sizes = notes.groupBy(tx.scope_of(F.col("id")).alias("scope")).agg(F.count("*").alias("n"))
    leading = links.groupBy("scope").agg(F.countDistinct("id").alias("leading"))
    return sizes.join(leading, "scope", "left").select("scope", "n", F.coalesce("leading", F.lit(0)).alias("leading"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "fgjms" and k[1:3].isdigit()}

_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_OLD = """o as (select * replace (case when status = 'completed' then 'active' else status end as status, list_filter(tags, lambda x: x <> 'backend') as tags,
  depends_on[2:] as depends_on, list_reverse(blocks) as blocks, replace(body, chr(13) || chr(10), chr(10)) as body,
  list_concat(acceptance, case when status = 'archived' then ['archived'] else [] end) as acceptance) from n)"""
_FIELDS = [("status", "coalesce({0}.status, '')"), ("title", "coalesce({0}.title, '')"), ("tags", "array_to_string({0}.tags, ', ')"), ("acceptance", "array_to_string({0}.acceptance, '; ')")]
_FIELDS += [(f"links.{t}", "array_to_string({0}." + t + ", ', ')") for t in schema.LINK_TYPES]
_M = "m as (select old, min(id) as new from (select id, unnest(supersedes) as old from n) group by old)"
_REVERSE = "case when link_type in ('relates_to', 'contradicts') then link_type when link_type = 'depends_on' then 'blocks' when link_type = 'blocks' then 'depends_on' end"

SQL = {
    "m01_create": f"""with x as (select 'doc-' || doc_id as id, case when kind is null or kind not in ({q.words(schema.TYPES)}) then 'type' when trim(coalesce(project, ''), {q.BLANK}) = '' then 'title'
  when coalesce(source, '') = '' or strlen(source) > 100 or not regexp_matches(source, '{schema.NAME_PATTERN}') then 'tags'
  when {secret_list(schema.BLOCKING_PATTERNS)} <> '' then 'blocked content' end as problem, {secret_list(schema.WARNING_PATTERNS)} as w from documents)
select id, problem, 'active' as status, 0.5::double as weight, 'normal' as origin, (case when w = '' then 0 else len(string_split(w, '; ')) end)::bigint as n_warnings from x""",
    "m08_snapshot": f"""with {NOTES} select id, '{AS_OF}' as snapshot_at, coalesce(status, '') as status, coalesce(title, '') as title, weight, array_to_string(tags, ', ') as tags,
  array_to_string(acceptance, '; ') as acceptance, array_to_string(list_filter([{', '.join(f"case when len({t}) > 0 then '{t}: ' || array_to_string({t}, ', ') end" for t in schema.LINK_TYPES)}], lambda x: x is not null), ' | ') as links,
  sha256(body) as body_hash from n""",
    "j21_note_changes": f"""with {NOTES}, {_OLD} select * from ({' union all '.join(f"select n.id, '{f}' as field, {e.format('o')} as old, {e.format('n')} as new from n join o using (id)" for f, e in _FIELDS)}) where old <> new
union all select n.id, 'body', '(changed)', '(changed)' from n join o using (id) where n.body <> o.body""",
    "g12_all_effects": f"""with {NOTES}, {LINKS}, asked as (select id as source, parent as target, unnest(['relates_to', 'builds_on']) as link_type from n
  union all select id, source_issue, unnest(['depends_on', 'supersedes']) from n),
v as (select distinct * from asked where source <> target and target in (select id from n)),
sides as (select source as id, link_type, target from v union select target, {_REVERSE}, source from v where {_REVERSE} is not null)
select 'edge' as effect, * from (select * from sides union select target, 'built_by_ref', source from v where link_type = 'builds_on')
union all select 'status', target, 'deprecated', source from v where link_type = 'supersedes'
union all select 'link', * from sides b where not exists (select 1 from links l where l.id = b.id and l.link_type = b.link_type and l.target = b.target)""",
    "g15_delete_effects": f"""with {NOTES}, {LINKS}, {_LE}, d as (select id from n where status = 'deprecated')
select 'trash' as effect, id, '' as link_type, '{AS_OF}' as target from d
union all select 'tombstone', source, edge_type, target from le where source in (select id from d) or target in (select id from d)
union all select distinct 'unlink', id, link_type, target from links where id not in (select id from d) and target in (select id from d)""",
    "g16_edge_lines": f"""with {_LE}, r as (select distinct target as source, source as target, edge_type from edges where edge_type = 'relates_to' and source is not null and target is not null)
select *, false as deleted from r where not exists (select 1 from le where le.source = r.source and le.target = r.target and le.edge_type = r.edge_type)
union all select source, target, edge_type, true from le where edge_type = 'contradicts'""",
    "g17_restore": f"""with {NOTES}, t as (select id from n where status = 'deprecated'), again as (select distinct x as id from (select unnest(supersedes) as x from n) where x in (select id from t))
select id, case when id not in (select id from t) then 'not in trash' when id in (select id from again) then 'exists' else 'restored' end as outcome from n where type = 'task'""",
    "f24_trash": f"""with {NOTES}, t as (select id, epoch_us(last_accessed) + 35 * 86400000000 - epoch_us(timestamp '{AS_OF}') as k from n where status = 'deprecated')
select id, coalesce(k <= 0, false) as expired, ceil(k / 86400000000)::bigint as days_left from t""",
    "j22_note_rewrite": f"""with {NOTES}, {_M}, p as (select id, i, piece, case when i > 1 then split_part(piece, ']]', 1) end as name
  from (select id, unnest(s) as piece, generate_subscripts(s, 1) as i from (select id, string_split(regexp_replace(body, '{schema.WIKI_LINK}', chr(1) || '\\1]]', 'g'), chr(1)) as s from n))),
b as (select id, string_agg(case when i = 1 then piece else '[[' || coalesce(m.new, name) || substr(piece, length(name) + 1) end, '' order by i) as body from p left join m on m.old = name group by id)
select n.id, coalesce(m.new, n.parent) as parent, md5(b.body) as hash from n join b using (id) left join m on m.old = n.parent""",
    "j23_merged_links": f"""with {NOTES}, {_LE}, {_M} select distinct * from (select coalesce(s.new, source) as source, edge_type, coalesce(t.new, target) as target from le left join m s on s.old = source left join m t on t.old = target
  where edge_type in ({q.words(tuple(t for t in schema.LINK_TYPES if t != 'supersedes'))}) and (s.new is not null or t.new is not null) and s.new is distinct from t.new) where source <> target""",
    "m10_forwarded": f"""with {NOTES}, x as (select *, type in ('decision', 'lesson', 'explore') as moves from n)
select case when moves then 'global-' || id else id end as id, null::varchar as forwarded_to, status from x union all select id, 'global-' || id, '' from x where moves""",
    "m05_toggle_items": f"""with {NOTES}, x as (select *, unnest(range(0, len(acceptance) + 1)) as item from n where len(acceptance) > 0)
select id, item::int as item, array_to_string(list_transform(range(1, len(acceptance) + 1), lambda i: (case when item = 0 then true else coalesce(acceptance_met[i], false) <> (i = item) end)::varchar), ',') as met from x""",
    "s08_origin_scopes": f"""with {NOTES}, {LINKS}, l as (select id, case when instr(id, '-') > 1 then split_part(id, '-', 1) else '' end as scope, case when instr(target, '-') > 1 then split_part(target, '-', 1) else '' end as other from links),
k as (select case when instr(id, '-') > 1 then split_part(id, '-', 1) else '' end as scope, count(*) as n from n group by 1), g as (select scope, count(distinct id) as c from l where scope <> other and other <> '' group by 1)
select k.scope, n, coalesce(c, 0) as leading from k left join g using (scope)""",
}
