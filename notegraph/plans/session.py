"""Queries of a session's start and end: visits, suggestions, flows, today's counts, what to resume, keywords of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import graph, logs, notes as ops
from notegraph.operators.notes import view
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, NOTES
from notegraph.sources.tables import folded, table
from notegraph.streaming import access

TODAY = "2017-02-01"
STAMP = "yyyy-MM-dd HH:mm:ss"


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """The notes as if their status had last changed when they were last seen."""
    return view(spark, folder, "created_at", "status", "last_accessed").withColumnRenamed("last_accessed", "status_changed_at")


def a05_net_flow(spark: SparkSession, folder: str) -> DataFrame:
    return ops.net_flow(_state(spark, folder), AS_OF, (20, 40, 60, 90))


def a17_bloat(spark: SparkSession, folder: str) -> DataFrame:
    return ops.bloated(_state(spark, folder), AS_OF, days=45)


def a06_graph_value(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge notes in force by type, their mean out-degree, notes followed up on three days or more, and the age in days."""
    notes = view(spark, folder, "type", "status", "created_at").filter("status not in ('deprecated', 'archived')")
    degree = graph.live_edges(table(spark, folder, "edges")).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out"))
    known = F.col("type").isin("decision", "lesson", "explore")
    rows = notes.join(degree, "id", "left").agg(
        *[F.count(F.when(F.col("type") == t, 1)).alias(t) for t in ("decision", "lesson", "explore")],
        F.round(F.avg(F.when(known, F.coalesce("out", F.lit(0)))), 6).alias("avg_links"),
        F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))) / 86400).alias("age_days"),
    )
    hits = logs.primed_days(table(spark, folder, "access_log")).filter("hit").groupBy("mote_id").count().filter("count >= 3").agg(F.count("*").alias("cross_session"))
    return rows.crossJoin(hits)


def f14_lingering(spark: SparkSession, folder: str) -> DataFrame:
    """Completed tasks made more than a week ago from which no note was made."""
    notes = view(spark, folder, "type", "status", "created_at", "source_issue")
    old = notes.filter(f"type = 'task' and status = 'completed' and created_at < timestamp_ntz'{AS_OF}' - interval 7 days").select("id")
    return old.join(notes.select(F.col("source_issue").alias("id")).filter("id is not null"), "id", "left_anti")


def f15_action_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Active lessons and decisions with a body and without an action, the most accessed first."""
    notes = view(spark, folder, "access_count", "body", where="status = 'active' and type in ('lesson', 'decision')")
    return notes.filter(F.btrim("body", F.lit(" \t\r\n")) != "").select("id", F.col("access_count").cast("bigint").alias("access_count")).orderBy(F.desc("access_count"), "id")


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    """Accesses by agent and half hour."""
    log = table(spark, folder, "access_log").filter("mote_id is not null and accessed_at is not null")
    hour = F.date_format(F.to_timestamp(F.floor(F.unix_timestamp(F.col("accessed_at").cast("timestamp")) / 1800) * 1800), STAMP)
    log = log.withColumn("agent", folded(F.col("agent_id"))).filter("agent <> ''")
    return log.select(F.concat_ws(" ", "agent", hour).alias("visit"), F.col("mote_id").alias("id"))


def j09_visit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return logs.visit_pairs(_visits(spark, folder), view(spark, folder, "tags"), graph.live_edges(table(spark, folder, "edges")))


def j16_unblocked(spark: SparkSession, folder: str) -> DataFrame:
    """For each completed note the tasks that depend on it and are ready now."""
    notes = view(spark, folder, "type", "status", "depends_on")
    done = notes.filter("status = 'completed'").select(F.col("id").alias("done"))
    waits = notes.select("id", F.explode(F.array_distinct("depends_on")).alias("done")).join(graph.ready(notes), "id", "left_semi")
    return waits.join(done, "done", "left_semi").select("done", "id")


def j17_tag_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """For each completed note the first three live tasks that share a tag."""
    notes = view(spark, folder, "type", "status", "tags")
    tasks = notes.filter((F.col("type") == "task") & F.col("status").isin(*schema.LIVE))
    return logs.tag_suggestions(notes.filter("status = 'completed'"), tasks)


def a31_queries_of_a_day(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one day by type, as a log of queries, and whether there were three or more."""
    day = table(spark, folder, "events").filter("to_date(ts) = date'2024-01-15'")
    return day.groupBy(F.col("event_type").alias("corpus")).agg(F.count("*").alias("n")).withColumn("often", F.col("n") >= 3)


def a32_types_of_a_day(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "type", "created_at").filter(f"to_date(created_at) = date'{TODAY}'")
    return notes.groupBy("type").agg(F.count("*").alias("n"))


def w08_last_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the latest access of each agent was primed."""
    log = table(spark, folder, "access_log").select(F.nullif(folded(F.col("agent_id")), F.lit("")).alias("agent"), "accessed_at", "primed")
    return logs.last_flags(log, "agent", "accessed_at", "primed")


def r21_resume(spark: SparkSession, folder: str) -> DataFrame:
    """What to take up again: live tasks, and notes accessed on the last two days of the log."""
    notes = view(spark, folder, "type", "status", "weight")
    tasks = notes.filter((F.col("type") == "task") & F.col("status").isin(*schema.LIVE)).select("id", F.lit("task").alias("why"), "weight")
    log = table(spark, folder, "access_log").filter("accessed_at is not null")
    since = F.lit(log.agg(F.max("accessed_at")).first()[0]).cast("timestamp_ntz") - F.expr("interval 2 days")
    seen = log.filter(F.col("accessed_at") > since).select(F.col("mote_id").alias("id")).distinct()
    return tasks.unionByName(notes.join(seen, "id", "left_semi").select("id", F.lit("accessed").alias("why"), "weight"))


def l05_short_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The five heaviest ready tasks and the two heaviest live ones."""
    notes = view(spark, folder, "type", "status", "weight", "depends_on")
    best = [F.desc_nulls_last("weight"), F.col("id")]
    ready = notes.join(graph.ready(notes), "id", "left_semi").orderBy(*best).limit(5).select(F.lit("ready").alias("list"), "id", "weight")
    live = notes.filter((F.col("type") == "task") & F.col("status").isin(*schema.LIVE)).orderBy(*best).limit(2)
    return ready.unionByName(live.select(F.lit("live").alias("list"), "id", "weight"))


def f01_ready_stale(spark: SparkSession, folder: str) -> DataFrame:
    """The list with its options: tasks that are ready, and active lessons that were not seen for ninety days."""
    notes = view(spark, folder, "type", "status", "depends_on", "last_accessed")
    ready = ops.list_notes(notes, kind="task").join(graph.ready(notes), "id", "left_semi").select(F.lit("ready").alias("list"), "id")
    stale = ops.list_notes(notes, kind="lesson", status="active").filter(ops.not_seen_for(45, AS_OF))
    return ready.unionByName(stale.select(F.lit("stale").alias("list"), "id"))


def x03_path_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of the addresses of each note's external references."""
    notes = view(spark, folder, "external_refs").select("id", F.filter(F.transform("external_refs", lambda r: r["url"]), lambda u: u.isNotNull()).alias("paths"))
    return notes.select("id", F.array_join(F.array_sort(tx.path_keywords(F.col("paths"))), " ").alias("words"))


def x12_matched_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of each note that its own title names."""
    found = tx.matched_tags(F.col("title"), F.col("tags"))
    found = view(spark, folder, "title", "tags").select("id", found.alias("found"))
    return found.select("id", F.array_join(F.array_sort("found"), ",").alias("tags"), F.size("found").cast("bigint").alias("n"))


def x46_titles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", tx.title_of(F.col("text")).alias("title"), F.md5(tx.body_of(F.col("text"))).alias("hash"))


def a19_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the hubs that would be made for tags on at least three notes without one."""
    notes = view(spark, folder, "type", "status", "tags")
    return ops.hub_links(notes, ops.missing_hubs(notes))


def a29_majority_types(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent type among the children of each note that has at least three."""
    notes = view(spark, folder, "parent", "type").filter("parent is not null")
    many = notes.groupBy("parent").count().filter("count >= 3").select("parent")
    return ops.majority(notes.join(many, "parent", "left_semi"), "parent", "type")


def a08_run_value(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a log of runs."""
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 9).alias("proposals"), (F.col("o_custkey") % 4).alias("applied"),
        F.greatest(F.col("o_custkey") % 9 - F.col("o_custkey") % 4, F.lit(0)).alias("deferred"), (F.col("o_totalprice") / 1e5).alias("cost"),
    )
    out = logs.run_value(runs)
    return out.select("runs", "proposals", "applied", "deferred", *[F.round(c, 4).alias(c) for c in ("cost", "acceptance", "cost_per_applied")], "low")


def t02_session_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each agent over the log as a stream, with the number of primed accesses."""
    found = access.session_counts(access.stream_of(spark, folder, "access_log"), folded(F.col("agent_id")), "accessed_at", 30 * 60 * 1_000_000, "primed")
    return found.select(F.col("entity").alias("agent"), F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("end_us"), "n", "n_flagged")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "afjlrtwx" and k[1:3].isdigit()}

_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_BLOCKED = """dep as (select distinct id, unnest(depends_on) as target from n),
blocked(id) as (select dep.id from dep left join n t on t.id = dep.target where t.id is null or t.status in ('active', 'in_progress')
  union select dep.id from dep join blocked on dep.target = blocked.id),
ready as (select id from n where type = 'task' and status = 'active' and id not in (select id from blocked))"""
_LIVE_TASK = "type = 'task' and status in ('active', 'in_progress')"
_AGENT = f"lower(trim(agent_id, {q.BLANK}))"
_SHUT = f"case when status in ('deprecated', 'archived', 'completed') then {q.days('last_accessed')} end"

SQL = {
    "a05_net_flow": f"""with {NOTES}, w as (select unnest([20, 40, 60, 90])::int as days), c as (select days, count(*) filter ({q.days('created_at')} < days) as created,
  count(*) filter ({_SHUT} < days) as closed from n cross join w group by days) select *, created - closed as net from c""",
    "a17_bloat": f"""with {NOTES}, c as (select count(*) as n, count(*) filter ({q.days('created_at')} < 45) as created, count(*) filter ({_SHUT} < 45) as closed from n)
select *, n >= 20 and created >= 15 and closed = 0 as bloat from c""",
    "a06_graph_value": f"""with {NOTES}, {_LE}, d as (select source as id, count(*) as k from le group by 1), x as (select n.*, coalesce(k, 0) as k from n left join d using (id) where status not in ('deprecated', 'archived')),
p as (select accessed_at::date as day, mote_id, bool_or(coalesce(primed, false)) as primed, bool_or(not coalesce(primed, false)) as hit from access_log where mote_id is not null and accessed_at is not null group by all),
h as (select mote_id from p where primed and hit group by 1 having count(*) >= 3)
select count(*) filter (type = 'decision') as decision, count(*) filter (type = 'lesson') as lesson, count(*) filter (type = 'explore') as explore,
  round(avg(k) filter (type in ('decision', 'lesson', 'explore')), 6) as avg_links, floor((epoch(timestamp '{AS_OF}') - floor(epoch(min(created_at)))) / 86400)::bigint as age_days,
  (select count(*) from h) as cross_session from x""",
    "f14_lingering": f"""with {NOTES} select id from n where type = 'task' and status = 'completed' and created_at < timestamp '{AS_OF}' - interval 7 days
  and id not in (select source_issue from n where source_issue is not null)""",
    "f15_action_candidates": f"with {NOTES} select id, access_count::bigint as access_count from n where status = 'active' and type in ('lesson', 'decision') and trim(body, {q.BLANK}) <> ''",
    "j09_visit_pairs": f"""with {NOTES}, {_LE}, v as (select distinct {_AGENT} || ' ' || strftime(to_timestamp(floor(epoch(accessed_at) / 1800) * 1800), '%Y-%m-%d %H:%M:%S') as visit, mote_id as id
  from access_log where mote_id is not null and accessed_at is not null and coalesce({_AGENT}, '') <> ''),
g as (select distinct visit, v.id, tag from v join (select id, unnest(tags) as tag from n) t on t.id = v.id),
p as (select x.visit, x.id as a, y.id as b, count(*) as n_shared from g x join g y on x.visit = y.visit and x.tag = y.tag and x.id < y.id group by all having count(*) >= 2)
select visit, a, b, n_shared, rank::int as rank from (select *, row_number() over (partition by visit order by a, b) as rank from p where not exists (select 1 from le where source = a and target = b)) where rank <= 3""",
    "j16_unblocked": f"with recursive {NOTES}, {_BLOCKED} select dep.target as done, dep.id from dep join ready using (id) join n t on t.id = dep.target and t.status = 'completed'",
    "j17_tag_suggestions": f"""with {NOTES}, g as (select distinct id, type, status, lower(tag) as tag from (select id, type, status, unnest(tags) as tag from n)),
m as (select distinct x.id, y.id as task from g x join g y using (tag) where x.status = 'completed' and y.{_LIVE_TASK.replace('status', 'y.status')} and x.id <> y.id)
select id, task, rank::int as rank from (select *, row_number() over (partition by id order by task) as rank from m) where rank <= 3""",
    "a31_queries_of_a_day": "select event_type as corpus, count(*) as n, count(*) >= 3 as often from events where ts::date = date '2024-01-15' group by 1",
    "a32_types_of_a_day": f"with {NOTES} select type, count(*) as n from n where created_at::date = date '{TODAY}' group by 1",
    "w08_last_flag": f"""with x as (select {_AGENT} as agent, accessed_at, coalesce(primed, false) as p from access_log where accessed_at is not null)
select agent, bool_or(p) as flag from (select *, max(accessed_at) over (partition by agent) as m from x where agent <> '') where accessed_at = m group by agent""",
    "r21_resume": f"""with {NOTES} select id, 'task' as why, weight from n where {_LIVE_TASK}
union all select id, 'accessed', weight from n where id in (select mote_id from access_log where accessed_at > (select max(accessed_at) from access_log) - interval 2 days)""",
    "l05_short_lists": f"""with recursive {NOTES}, {_BLOCKED} select * from (select 'ready' as list, id, weight from n where id in (select id from ready) order by weight desc nulls last, id limit 5)
union all select * from (select 'live', id, weight from n where {_LIVE_TASK} order by weight desc nulls last, id limit 2)""",
    "f01_ready_stale": f"""with recursive {NOTES}, {_BLOCKED} select 'ready' as list, id from ready
union all select 'stale', id from n where type = 'lesson' and status = 'active' and (last_accessed is null or last_accessed <= timestamp '{AS_OF}' - interval 45 days)""",
    "x03_path_keywords": f"""with u as (select distinct on (id) id, external_refs from notes where id is not null order by id), p as (select id, unnest(external_refs).url as url from u),
k as (select distinct id, unnest({q.keyword_list('url')}) as w from p) select u.id, coalesce(string_agg(w, ' ' order by w), '') as words from u left join k using (id) group by u.id""",
    "x12_matched_tags": f"""with {NOTES}, k as (select id, unnest({q.keyword_list('title')}) as word from n),
t as (select id, tag, i from (select id, unnest(tags) as tag, generate_subscripts(tags, 1) as i from n)),
m as (select k.id, word, arg_min(tag, i) as tag from k join t on t.id = k.id and lower(tag) = word group by all)
select n.id, coalesce(string_agg(tag, ',' order by tag), '') as tags, count(tag) as n from n left join m using (id) group by n.id""",
    "x46_titles": f"""with x as (select doc_id, trim(text, {q.BLANK}) as t from documents)
select doc_id, trim(case when instr(t, chr(10)) > 0 then left(t, instr(t, chr(10)) - 1) else t end, {q.BLANK}) as title,
  md5(case when instr(t, chr(10)) > 0 then trim(substr(t, instr(t, chr(10)) + 1), {q.BLANK}) when t is not null then '' end) as hash from x""",
    "a19_hubs": f"""with {NOTES}, g as (select distinct id, type, tag from (select id, type, unnest(tags) as tag from n where status <> 'deprecated')),
h as (select tag from g group by tag having count(*) >= 3 and not coalesce(bool_or(type = 'constellation'), false)), m as (select 'hub-' || tag as hub, id from g join h using (tag))
select hub as source, id as target, 'relates_to' as edge_type from m union all select id, hub, 'relates_to' from m""",
    "a29_majority_types": f"""with {NOTES}, c as (select parent, type, count(*) as n from n where parent is not null and type is not null group by all),
big as (select parent from n where parent is not null group by 1 having count(*) >= 3)
select parent, type, n from c where parent in (select parent from big) qualify row_number() over (partition by parent order by n desc, type) = 1""",
    "a08_run_value": """with r as (select o_orderkey as pos, o_custkey % 9 as v, o_custkey % 4 as a, greatest(o_custkey % 9 - o_custkey % 4, 0) as d, o_totalprice / 1e5 as cost from orders),
l as (select sum(a) as a, sum(v) as v from (select * from r order by pos desc limit 5))
select count(*) as runs, sum(r.v)::bigint as proposals, sum(r.a)::bigint as applied, sum(d)::bigint as deferred, round(sum(cost), 4) as cost, round(sum(r.a) / sum(r.v), 4) as acceptance,
  round(sum(cost) / sum(r.a), 4) as cost_per_applied, coalesce(any_value(l.a / nullif(l.v, 0)) < 0.25, false) as low from r, l""",
    "t02_session_hits": f"""with x as (select {_AGENT} as agent, epoch_us(accessed_at) as t, coalesce(primed, false) as p from access_log where accessed_at is not null),
y as (select *, case when t - lag(t) over w <= 1800000000 then 0 else 1 end as new from x where agent <> '' window w as (partition by agent order by t)),
z as (select *, sum(new) over (partition by agent order by t range unbounded preceding) as s from y)
select agent, min(t) as start_us, max(t) as end_us, count(*) as n, count(*) filter (p) as n_flagged from z group by agent, s""",
}
