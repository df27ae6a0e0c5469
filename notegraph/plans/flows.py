"""Queries of streaming jobs, changes and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import changes, graph
from notegraph.operators.notes import view
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, LINKS, NOTES
from notegraph.sources.corpus import index_line
from notegraph.sources.logs import new_notes
from notegraph.sources.tables import distinct_notes, table
from notegraph.streaming import access

STAMP = "yyyy-MM-dd HH:mm:ss"


def t01_access_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = access.access_counts(access.stream_of(spark, folder, "access_log"))
    return counts.select("mote_id", "n", F.date_format("last", STAMP).alias("last"))


def t03_rolling_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type in windows of seven days that start every day."""
    counts = access.windowed_counts(access.stream_of(spark, folder, "events"), "ts", "event_type", "7 days", "1 day")
    return counts.select(F.date_format("start", STAMP).alias("start"), F.col("key").alias("event_type"), "n")


def t04_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = access.windowed_counts(access.stream_of(spark, folder, "events"), "ts", "event_type", "1 day")
    return counts.select(F.date_format("start", STAMP).alias("start"), F.col("key").alias("event_type"), "n")


def t06_live_edges(spark: SparkSession, folder: str) -> DataFrame:
    return access.folded_edges(access.stream_of(spark, folder, "edges"))


def s29_index(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "type", "title", "body").select("type", index_line().alias("line"))


def s25_new_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to take over as notes whose content no note has yet, each content once."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("kind").alias("type"), F.lit("").alias("title"), F.col("text").alias("body")
    )
    return new_notes(docs, distinct_notes(table(spark, folder, "notes"), "type", "title", "body")).select("id", "type")


def m02_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the notes after completed ones not seen for six weeks are archived."""
    notes = view(spark, folder, "status", "last_accessed")
    old = notes.filter(f"status = 'completed' and last_accessed < timestamp_ntz'{AS_OF}' - interval 42 days")
    state = changes.apply_patch(notes, old.select("id", F.lit("archived").alias("status")), AS_OF)
    return state.select("id", "status", F.date_format("status_changed_at", STAMP).alias("status_changed_at"))


def m04_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after feedback: accessed without being primed counts as useful, never accessed as irrelevant."""
    used = table(spark, folder, "access_log").filter("not primed and mote_id is not null").select(F.col("mote_id").alias("id")).distinct()
    marked = view(spark, folder, "weight").join(used.withColumn("used", F.lit(True)), "id", "left")
    word = F.when(F.col("used"), "useful").otherwise("irrelevant")
    return marked.select("id", F.round(changes.adjusted_weight(word), 6).alias("weight"))


def m05_toggle(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "acceptance", "acceptance_met").filter(F.size("acceptance") > 0)
    return notes.select("id", F.array_join(F.transform(changes.toggled(F.lit(1)), lambda x: x.cast("string")), ",").alias("met"))


def g14_unlink(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "edges").filter("deleted").select("source", "target", F.col("edge_type").alias("link_type"))
    return changes.unlink(view(spark, folder, *schema.LINK_TYPES), gone).distinct()


def g15_delete(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "status", *schema.LINK_TYPES)
    return changes.delete(notes, notes.filter("status = 'deprecated'").select("id"))[1].distinct()


def j22_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Links after every note that another supersedes has handed its links to it."""
    notes = view(spark, folder, *schema.LINK_TYPES)
    moved = notes.select(F.col("id").alias("new"), F.explode("supersedes").alias("old")).groupBy("old").agg(F.min("new").alias("new"))
    return changes.rewrite_links(notes, moved)


def s06_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks and what is kept of the whole collection seen as the shared scope."""
    notes = view(spark, folder, "type", "status")
    return changes.merge_scopes(notes.filter("type = 'task'"), notes)


def x45_first_words(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies cut to 200 words for a prompt, as their length and hash."""
    words = tx.fields(F.col("body"))
    cut = F.array_join(F.slice(words, 1, 200), " ")
    return view(spark, folder, "body").select("id", F.least(F.size(words), F.lit(200)).cast("bigint").alias("n_words"), F.md5(cut).alias("hash"))


def j20_link_survival(spark: SparkSession, folder: str) -> DataFrame:
    """Of the links noted in the edge log, how many each link type still has in the notes."""
    log = table(spark, folder, "edges").filter(F.col("edge_type").isin(*schema.LINK_TYPES)).select(F.col("source").alias("id"), F.col("edge_type").alias("link_type"), "target").distinct()
    held = graph.links_in(view(spark, folder, *schema.LINK_TYPES)).select("id", "link_type", "target", F.lit(1).alias("held")).distinct()
    return log.join(held, ["id", "link_type", "target"], "left").groupBy("link_type").agg(F.count("*").alias("noted"), F.count("held").alias("held"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "gjmstx" and k[1:3].isdigit()}

_GONE = """gone as (select source as id, edge_type as link_type, target from edges where deleted
  union select target, case edge_type when 'depends_on' then 'blocks' when 'blocks' then 'depends_on' else edge_type end, source
  from edges where deleted and edge_type in ('depends_on', 'blocks', 'relates_to', 'contradicts'))"""

SQL = {
    "t01_access_counts": "select mote_id, count(*) as n, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') as last from access_log where mote_id is not null and accessed_at is not null group by 1",
    "t03_rolling_flow": """with x as (select event_type, unnest(generate_series(date_trunc('day', ts) - interval 6 days, date_trunc('day', ts), interval 1 day)) as w from events where ts is not null)
select strftime(w, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from x group by all""",
    "t04_daily_counts": "select strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') as start, event_type, count(*) as n from events where ts is not null group by all",
    "t06_live_edges": "select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false))",
    "s29_index": f"""with {NOTES}, x as (select id, type, title, list_filter(list_transform(string_split(body, chr(10)), lambda v: trim(v, ' ' || chr(9) || chr(13))),
  lambda v: v <> '' and not starts_with(v, '#'))[1] as line from n), y as (select id, type, title, regexp_replace(regexp_replace(line, '^[-*] ', ''), '\\*\\*|__', '', 'g') as line from x),
z as (select id, type, title, coalesce(case when length(line) > 120 then left(line, 117) || '...' else line end, '') as hook from y),
l as (select type, '- [' || coalesce(nullif(title, ''), id) || '](nodes/' || id || '.md)' || case when hook <> '' then ' — ' || hook else '' end as line from z)
select type, case when length(line) > 200 then left(line, 197) || '...' else line end as line from l""",
    "s25_new_notes": """with x as (select doc_id::varchar as id, kind as type, sha256(coalesce(kind, '') || coalesce(text, '')) as h from documents)
select id, type from x where h not in (select sha256(coalesce(type, '') || coalesce(title, '') || coalesce(body, '')) from notes)
qualify row_number() over (partition by h order by id) = 1""",
    "m02_archive": f"""with {NOTES}, x as (select id, status, status = 'completed' and last_accessed < timestamp '{AS_OF}' - interval 42 days as old from n)
select id, case when old then 'archived' else status end as status, case when old then '{AS_OF}' end as status_changed_at from x""",
    "m04_weights": f"""with {NOTES} select id, round(greatest(0.1::double, least(1.0::double, weight +
  case when id in (select mote_id from access_log where not primed and mote_id is not null) then 0.05::double else -0.05::double end)), 6) as weight from n""",
    "m05_toggle": f"""with {NOTES} select id, array_to_string(list_transform(range(1, len(acceptance) + 1),
  lambda i: (coalesce(acceptance_met[i], false) <> (i = 1))::varchar), ',') as met from n where len(acceptance) > 0""",
    "g14_unlink": f"with {NOTES}, {LINKS}, {_GONE} select distinct id, link_type, target from links l where not exists (select 1 from gone g where g.id = l.id and g.link_type = l.link_type and g.target = l.target)",
    "g15_delete": f"""with {NOTES}, {LINKS}, d as (select id from n where status = 'deprecated')
select distinct id, link_type, target from links where id not in (select id from d) and target not in (select id from d)""",
    "j22_rewrite": f"""with {NOTES}, {LINKS}, m as (select old, min(id) as new from (select id, unnest(supersedes) as old from n) group by old)
select distinct id, link_type, target from (select coalesce(s.new, l.id) as id, link_type, coalesce(t.new, l.target) as target
  from links l left join m s on s.old = l.id left join m t on t.old = l.target) where id <> target""",
    "s06_scopes": f"with {NOTES} select id, type, status from n where type = 'task' or (type <> 'context' and status not in ('archived', 'deprecated'))",
    "x45_first_words": f"""with {NOTES}, w as (select id, {q.fields('body')} as w from n)
select id, least(len(w), 200)::bigint as n_words, md5(array_to_string(w[1:200], ' ')) as hash from w""",
    "j20_link_survival": f"""with {NOTES}, {LINKS}, l as (select distinct source as id, edge_type as link_type, target from edges where edge_type in ({q.words(schema.LINK_TYPES)})),
h as (select distinct id, link_type, target, 1 as held from links)
select link_type, count(*) as noted, count(held) as held from l left join h using (id, link_type, target) group by link_type""",
}
