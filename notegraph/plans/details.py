"""Queries of the parts that summaries elsewhere leave out: members, lists, sections, cycles, depth, parsed references, levels of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import chunks, graph, logs, notes as ops, retrieval
from notegraph.operators.components import connected_components
from notegraph.operators.notes import view
from notegraph.plans import retrieval as base
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, LINKS, NOTES
from notegraph.scratch import materialize
from notegraph.sources import corpus as files
from notegraph.sources.tables import table


def s23_section_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of each document that have a body, with level, heading and a hash of the body."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunks.sections(docs).select("id", "idx", "level", "heading", F.md5("body").alias("hash"))


def a15_tag_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every tag with the notes that carry it, one row for each and its place in the list."""
    rows = view(spark, folder, "tags").select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return ops.listed(rows, "tag", "id")


def j19_concept_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every concept with the notes that refer to it, one row for each and its place in the list."""
    refs = graph.live_edges(table(spark, folder, "edges")).filter("edge_type = 'concept_ref'")
    return ops.listed(refs.select(F.col("target").alias("term"), F.col("source").alias("id")), "term", "id")


def a14_split_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """For tags on more than fifteen notes the companions by which they could be split."""
    notes = view(spark, folder, "tags")
    over = ops.tag_counts(notes).filter("n > 15").select("tag")
    return ops.companions(notes).join(over, "tag", "left_semi").select("tag", F.concat_ws("-", "tag", "other").alias("suggested"), "n", "rank")


def a23_dominant_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Dominant notes that are active and accessed often enough for the whole bonus."""
    often = int(schema.SCORING.max_access_bonus / schema.SCORING.per_access)
    notes = view(spark, folder, "status", "access_count", where="status = 'active'").filter(F.col("access_count") >= often)
    found = logs.dominant_notes(table(spark, folder, "access_log"), sessions=35, min_primed=2, below=0.9)
    return found.join(notes.select(F.col("id").alias("mote_id")), "mote_id", "left_semi")


def a24_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Members of disjoint clusters to sum up: each completed note in the largest cluster of two tags that it belongs to."""
    notes = view(spark, folder, "type", "status", "title", "tags", "builds_on")
    return ops.summary_clusters(notes, 5)


def g08_cycle_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Number of notes on the shortest cycle through each note that depends on itself."""
    notes = view(spark, folder, "depends_on", "builds_on", "caused_by")
    edges = notes.select(F.col("id").alias("source"), F.explode(F.concat("depends_on", "builds_on", "caused_by")).alias("target"))
    edges = edges.join(notes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")
    return graph.shortest_cycles(edges, notes.select("id")).select("id", F.size("cycle").alias("n"))


def g10_depth(spark: SparkSession, folder: str) -> DataFrame:
    """The largest number of steps from a root over depends_on; 0 without roots."""
    notes = view(spark, folder, "depends_on")
    levels = graph.levels(notes.select(F.col("id").alias("source"), F.explode("depends_on").alias("target")))
    return levels.agg(F.coalesce(F.max("level"), F.lit(0)).cast("bigint").alias("depth"))


def g07_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Around each active task: steps back over depends_on as negative levels, steps on over blocks as positive ones."""
    notes = view(spark, folder, "type", "status", "depends_on", "blocks")
    starts = notes.filter("type = 'task' and status = 'active'").select("id")
    return graph.chains(notes, starts)


def g11_cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Connected groups of at least three very similar notes, with the mean of the better scores of their pairs."""
    found = materialize(retrieval.similar(base.note_index(spark, folder), 5, base.MERGE_SCORE), "similar")
    pairs = found.groupBy(F.least("src", "id").alias("a"), F.greatest("src", "id").alias("b")).agg(F.max("score").alias("score"))
    members = materialize(connected_components(pairs.select("a", "b")), "members")
    sized = members.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 3")
    scores = pairs.join(members.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.avg("score").alias("score"))
    return sized.join(scores, "component").select("component", "n", F.round("score", 6).alias("score"))


def r10_new_links(spark: SparkSession, folder: str) -> DataFrame:
    """Similar notes without a link and without three terms in common, which another list has."""
    edges = graph.live_edges(table(spark, folder, "edges"))
    # no edge links these pairs, so those of the other list are the ones with enough terms in common
    return ops.without_shared_terms(base.r10_content_links(spark, folder), view(spark, folder, "status", "tags"), edges)


def j13_annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Live edges with a missing end, and whether a missing end is among the deleted notes (here the archived ones)."""
    notes = view(spark, folder, "status")
    trash = notes.filter("status = 'archived'").select("id")
    found = graph.dangling(graph.live_edges(table(spark, folder, "edges")), notes.join(trash, "id", "left_anti"))
    ends = found.join(trash.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(trash.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    return ends.select("source", "target", "edge_type", "missing", (F.col("s").isNotNull() | F.col("t").isNotNull()).alias("in_trash"))


def x18_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Least scores of both uses for collections as large as each project's documents."""
    sizes = table(spark, folder, "documents").groupBy("project").agg(F.count("*").alias("n_docs"))
    prompt, content = retrieval.threshold_columns(F.col("n_docs"))
    return sizes.select("project", "n_docs", F.round(prompt, 6).alias("prompt_context"), F.round(content, 6).alias("content_similarity"))


def x38_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """External references written as text and read back."""
    refs = table(spark, folder, "notes").select("id", F.inline("external_refs").alias("provider", "ref", "url")).filter("provider is not null and ref is not null").distinct()
    written = refs.select("id", F.concat_ws(":", F.regexp_replace("provider", ":", ""), F.regexp_replace("ref", ":", ""), "url").alias("text"))
    return written.select("id", tx.external_ref(F.col("text")).alias("r")).select("id", "r.provider", F.col("r.id").alias("ref"), "r.url")


def x15_full_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The whole score of every target of a live edge: bonus of the edge, matched tags, contradictions with other notes in force."""
    notes = view(spark, folder, "tags", "weight", "status", "origin", "type", "access_count", "last_accessed")
    edges = graph.live_edges(table(spark, folder, "edges"))
    return graph.edge_scores(edges.filter("edge_type <> 'concept_ref'"), notes, edges, AS_OF).select("source", "id", "edge_type", F.round("score", 6).alias("score"))


def f16_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Active notes that were never seen, or not for more than forty days."""
    notes = view(spark, folder, "last_accessed", where="status = 'active'")
    return notes.filter(F.col("last_accessed").isNull() | (F.col("last_accessed") < F.expr(f"timestamp_ntz'{AS_OF}' - interval 40 days"))).select("id")


def c05_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, cut as their extension asks for: those with a ``def`` or ``class`` line as code."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    name = F.when(F.coalesce("text", F.lit("")).rlike(r"(?m)^(def|class) "), F.concat("id", F.lit(".py"))).otherwise(F.concat("id", F.lit(".md")))
    return files.chunked(docs.withColumn("path", name)).select("id", "idx", "heading", F.md5("text").alias("hash"))


def u05_lens_union(spark: SparkSession, folder: str) -> DataFrame:
    """Edges as the notes and as the log have them, each marked with where it comes from, all kept."""
    own = graph.edges_of(view(spark, folder, *schema.LINK_TYPES, "parent", "body")).select(F.lit("notes").alias("lens"), "source", "target", "edge_type")
    return own.unionByName(table(spark, folder, "edges").select(F.lit("log").alias("lens"), "source", "target", "edge_type")).groupBy("lens", "edge_type").agg(F.count("*").alias("n"))


def w05_by_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """For each deprecated note the three heaviest live notes that share a tag, and who comes next."""
    return ops.successors(view(spark, folder, "status", "tags", "weight"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "acfgjrsuwx" and k[1:3].isdigit()}

_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_CYCLE_EDGES = "e as (select distinct id as s, t from (select id, unnest(list_concat(list_concat(depends_on, builds_on), caused_by)) as t from n) where t in (select id from n))"

SQL = {
    "s23_section_texts": f"""with l as (select doc_id as id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
m as (select *, regexp_matches(line, '^#{{1,4}}[ \\t]+\\S') as head, sum(case when regexp_matches(line, '^#{{1,4}}[ \\t]+\\S') then 1 else 0 end) over (partition by id order by i) as k from l),
b as (select id, k, max(line) filter (head) as head, trim(string_agg(line, chr(10) order by i) filter (not head), {q.BLANK}) as body from m where k > 0 group by id, k)
select id, k::int as idx, length(regexp_extract(head, '^(#+)', 1))::int as level, trim(regexp_extract(head, '^#+(.*)$', 1), {q.BLANK}) as heading, md5(body) as hash from b where coalesce(body, '') <> ''""",
    "a15_tag_members": f"with {NOTES}, x as (select distinct id, tag from (select id, unnest(tags) as tag from n)) select tag, id, row_number() over (partition by tag order by id) as place from x",
    "j19_concept_sources": f"with {_LE} select target as term, source as id, row_number() over (partition by target order by source) as place from le where edge_type = 'concept_ref'",
    "a14_split_suggestions": f"""with {NOTES}, i as (select distinct id, tag from (select id, unnest(tags) as tag from n)), c as (select x.tag, y.tag as other, count(*) as n from i x join i y on x.id = y.id and x.tag <> y.tag group by all),
o as (select tag from (select unnest(tags) as tag from n) group by tag having count(*) > 15), r as (select *, row_number() over (partition by tag order by n desc, other)::int as rank from c)
select tag, tag || '-' || other as suggested, n, rank from r where rank <= 3 and tag in (select tag from o)""",
    "a23_dominant_notes": f"""with {NOTES}, pd as (select accessed_at::date as day, mote_id, bool_or(coalesce(primed, false)) as primed, bool_or(not coalesce(primed, false)) as hit from access_log where mote_id is not null and accessed_at is not null group by all),
p as (select * from pd where primed), recent as (select distinct day from p order by day desc limit 35), d as (select mote_id, count(*) as primed, count(*) filter (hit) as hits from p where day in (select day from recent) group by mote_id)
select * from d where primed >= 2 and hits / primed < 0.9 and mote_id in (select id from n where status = 'active' and access_count >= {int(schema.SCORING.max_access_bonus / schema.SCORING.per_access)})""",
    "a24_clusters": f"""with {NOTES}, s as (select unnest(builds_on) as id from n where type = 'context' and contains(coalesce(title, ''), 'Summary')),
i as (select distinct id, tag from (select id, unnest(tags) as tag from n where status = 'completed' and id not in (select id from s))),
p as (select x.id, x.tag as a, y.tag as b from i x join i y on x.id = y.id and x.tag < y.tag), z as (select a, b, count(*) as n from p group by all having count(*) >= 5),
m as (select id, a, b, n from p join z using (a, b) qualify row_number() over (partition by id order by n desc, a, b) = 1)
select id, a, b from m qualify count(*) over (partition by a, b) >= 5""",
    "g08_cycle_lengths": f"""with recursive {NOTES}, {_CYCLE_EDGES}, reach(s, t) as (select s, t from e union select r.s, e.t from reach r join e on r.t = e.s), cn as (select s as id from reach where s = t),
ce as (select * from e where s in (select id from cn) and t in (select id from cn)), w(start, node, k) as (select s, t, 1 from ce union select w.start, ce.t, w.k + 1 from w join ce on ce.s = w.node where w.node <> w.start and w.k < (select count(*) from cn))
select start as id, min(k)::int as n from w where start = node group by start""",
    "g10_depth": f"""with recursive {NOTES}, e as (select distinct id as s, unnest(depends_on) as t from n),
l(node, level) as (select distinct s, 0::bigint from e where s not in (select t from e) union select e.t, l.level + 1 from l join e on e.s = l.node where l.level < (select count(*) from e))
select coalesce(max(level), 0)::bigint as depth from (select node, min(level) as level from l group by node)""",
    "g07_chains": f"""with recursive {NOTES}, d as (select distinct id as s, unnest(depends_on) as t from n), b as (select distinct id as s, unnest(blocks) as t from n), st as (select id from n where type = 'task' and status = 'active'),
back(start, node, level) as (select id, id, 0 from st union select start, d.t, level - 1 from back join d on d.s = node where level > -40),
ahead(start, node, level) as (select id, id, 0 from st union select start, b.t, level + 1 from ahead join b on b.s = node where level < 40),
x as (select start, node, max(level) as level from back group by all union all select start, node, min(level) from ahead group by all)
select start as id, node, (arg_min(level, (abs(level), level)))::bigint as level from x where node in (select id from n) group by start, node""",
    "g11_cluster_scores": f"""with recursive {NOTES}, {q.bm25(base._ND)}, {base._SIM}, best as (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= {base.MERGE_SCORE}),
pairs as (select least(src, id) as a, greatest(src, id) as b, max(score) as score from best where r <= 5 group by all), e as (select a, b from pairs union select b, a from pairs),
reach(node, other) as (select a, b from e union select reach.node, e.b from reach join e on e.a = reach.other), comp as (select node, least(node, min(other)) as component from reach group by node)
select component, (select count(*) from comp c where c.component = comp.component) as n, round(avg(score), 6) as score from pairs join comp on comp.node = pairs.a group by component having n >= 3""",
    "r10_new_links": f"""with {NOTES}, {_LE}, i as (select distinct id, term from (select id, unnest(tags) as term from n where coalesce(status, '') <> 'deprecated' union all select source, target from le where edge_type = 'concept_ref') where id is not null and term is not null),
p as (select x.id as a, y.id as b from i x join i y on x.term = y.term and x.id < y.id where not exists (select 1 from le where le.source = x.id and le.target = y.id) group by all having count(*) >= 3)
select r.* from ({base.SQL['r10_content_links']}) r where not exists (select 1 from p where p.a = r.a and p.b = r.b)""",
    "j13_annotated": f"""with {NOTES}, {_LE}, tr as (select id from n where status = 'archived'), k as (select id from n where status is distinct from 'archived'), x as (select *, source in (select id from k) as s, target in (select id from k) as t from le where edge_type <> 'concept_ref')
select source, target, edge_type, case when not s and not t then 'both' when not s then 'source' else 'target' end as missing, source in (select id from tr) or target in (select id from tr) as in_trash from x where not (s and t)""",
    "x18_thresholds": """with c as (select project, count(*) as n_docs from documents group by project), r as (select *, ln((n_docs - 0.5) / 1.5 + 1) / ln((50 - 0.5) / 1.5 + 1) as x from c)
select project, n_docs, round(least(greatest(2.0 * x, 0.3), 6.0), 6) as prompt_context, round(least(greatest(x, 0.15), 3.0), 6) as content_similarity from r""",
    "x38_parsed": """with r as (select distinct id, x.provider as provider, x.id as ref, x.url as url from (select id, unnest(external_refs) as x from notes)) select distinct id, replace(provider, ':', '') as provider, replace(ref, ':', '') as ref, url from r where provider is not null and ref is not null""",
    "x15_full_scores": f"""with {NOTES}, {_LE}, counts as (select tag, count(*) as c from (select unnest(tags) as tag from n) group by tag), m as (select id, avg(1.0::double / log2(c + 2)) as matched from (select id, unnest(tags) as tag from n) join counts using (tag) group by id),
dis as (select source as id, count(*) as k from (select distinct source, target from le where edge_type = 'contradicts') join n t on t.id = target and t.status <> 'deprecated' group by 1),
x as (select source, edge_type, n.*, coalesce(matched, 0.0::double) as matched, coalesce(k, 0) as disputed from le join n on n.id = le.target left join m on m.id = n.id left join dis on dis.id = n.id where edge_type <> 'concept_ref')
select source, id, edge_type, round({q.relevance('edge_type', 'matched', 'disputed')}, 6) as score from x""",
    "f16_stale": f"with {NOTES} select id from n where status = 'active' and (last_accessed is null or last_accessed < timestamp '{AS_OF}' - interval 40 days)",
    "c05_chunks": f"""with code as (select doc_id as id from documents where regexp_matches(coalesce(text, ''), '(?m)^(def|class) '))
select * from ({base.SQL['c02_heading_chunks']}) where id not in (select id from code) union all select * from ({base.SQL['c03_function_chunks']}) where id in (select id from code)""",
    "u05_lens_union": f"""with {NOTES}, {LINKS}, f as (select id as source, unnest(list_distinct(list_filter(regexp_extract_all(body, '{schema.WIKI_LINK}', 1), lambda x: x <> id))) as target from n),
e as (select link_type as edge_type from links union all select 'built_by_ref' from links where link_type = 'builds_on' union all select unnest(['child_of', 'parent_of']) from n where parent is not null
  union all select case when target in (select id from n) then 'body_ref' else 'concept_ref' end from f)
select 'notes' as lens, edge_type, count(*) as n from e group by edge_type union all select 'log', edge_type, count(*) from edges group by edge_type""",
    "w05_by_similarity": f"""with {NOTES}, g as (select distinct id, status, weight, tag from (select id, status, weight, unnest(tags) as tag from n)),
m as (select x.id as gone, y.id, y.weight, count(*) as n_shared from g x join g y using (tag) where x.status = 'deprecated' and y.status in ('active', 'in_progress') group by all),
r as (select *, row_number() over w as rank, lead(id) over w as next_id from m window w as (partition by gone order by weight desc nulls last, id))
select gone as id, id as successor, n_shared, rank::int as rank, next_id from r where rank <= 3""",
}
