"""Queries over the access log and the links between notes: sessions (p3) and hierarchies (p4)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.hierarchy import CYCLE, cycle_members, descendants, hierarchy
from notegraph.operators.sessions import gap_tree, sessions_at
from notegraph.sources.tables import distinct_notes, folded, micros, table

MINUTE = 60_000_000
SESSION_GAP = 30 * MINUTE
PROFILE_GAPS = (5 * MINUTE, 15 * MINUTE, 30 * MINUTE, 60 * MINUTE, 240 * MINUTE, 1440 * MINUTE)


def access_tree(spark: SparkSession, folder: str, gaps_us: tuple[int, ...] | None) -> DataFrame:
    log = table(spark, folder, "access_log").filter("accessed_at is not null and mote_id is not null and year(accessed_at) <> 1970")
    log = log.filter(folded(F.col("agent_id")) != "")
    return gap_tree(log, folded(F.col("agent_id")), micros(log, "accessed_at"), F.col("mote_id"), gaps_us)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = sessions_at(access_tree(spark, folder, (SESSION_GAP,)), SESSION_GAP)
    return found.select(F.col("entity").alias("agent_id"), "start_us", "end_us", "n_events")


def p3_gap_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Number, mean length and mean size of the sessions at several gaps, all from one tree."""
    tree = access_tree(spark, folder, PROFILE_GAPS)
    per_gap = None
    for gap in PROFILE_GAPS:
        one = sessions_at(tree, gap).agg(
            F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("longest_us")
        ).select(F.lit(gap).cast("bigint").alias("gap_us"), "*")
        per_gap = one if per_gap is None else per_gap.unionByName(one)
    return per_gap


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_notes(table(spark, folder, "notes"), "parent")


def _dependencies(spark: SparkSession, folder: str) -> DataFrame:
    notes = distinct_notes(table(spark, folder, "notes"), "depends_on")
    return notes.select(F.col("id").alias("source"), F.explode("depends_on").alias("target"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    notes = _parents(spark, folder)
    has_parent = notes.select(F.trim("id").alias("id"), F.btrim("parent", F.lit(" \t\r\n")).alias("parent")).filter("parent <> ''")
    # the two relations are independent, so their rounds share the cluster
    with ThreadPoolExecutor(2) as pool:
        trees = pool.submit(hierarchy, notes, notes.select("id"))
        loops = pool.submit(cycle_members, _dependencies(spark, folder), notes.select("id"))
        trees, loops = trees.result(), loops.result()
    placed = trees.join(has_parent.select("id"), "id", "left_semi")
    rows = placed.select(F.lit("parent").alias("relation"), "id", "root_id", F.col("depth").cast("int").alias("depth"))
    return rows.unionByName(
        loops.select(F.lit("depends_on").alias("relation"), "id", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"))
    )


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    notes = _parents(spark, folder)
    return hierarchy(notes, notes.select("id"), with_paths=True)


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(p4_paths(spark, folder))


QUERIES = {
    "p3_found": p3_found,
    "p3_gap_profile": p3_gap_profile,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
}

_ACCESSES = r"""
accesses as (
  select distinct lower(trim(agent_id, ' ' || chr(9) || chr(10) || chr(13))) as agent_id, mote_id, epoch_us(accessed_at) as t
  from access_log where mote_id is not null and year(accessed_at) <> 1970
    and trim(agent_id, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
moments as (select agent_id, t, count(*) as k from accesses group by agent_id, t),
gaps as (select agent_id, t, k, t - lag(t) over (partition by agent_id order by t) as gap from moments)
"""

_FOREST = r"""
n as (select id, any_value(trim(parent, ' ' || chr(9) || chr(10) || chr(13))) as parent from notes group by id),
up as (select n.id, p.id as parent from n left join n p on n.parent = p.id),
walk(id, node, path, depth) as (
  select id, id, [id], 0 from up where parent is null
  union all select c.id, c.id, list_append(w.path, c.id), w.depth + 1 from walk w join up c on c.parent = w.node)
"""

SQL = {
    "p3_found": f"""with {_ACCESSES},
numbered as (select agent_id, t, k, sum(case when gap > {SESSION_GAP} or gap is null then 1 else 0 end)
  over (partition by agent_id order by t rows unbounded preceding) as s from gaps)
select agent_id, min(t) as start_us, max(t) as end_us, sum(k)::bigint as n_events from numbered group by agent_id, s""",
    "p3_gap_profile": f"""with {_ACCESSES},
cut as (select g.limit_us, agent_id, t, k, sum(case when gap > g.limit_us or gap is null then 1 else 0 end)
  over (partition by g.limit_us, agent_id order by t rows unbounded preceding) as s
  from gaps, (select unnest([{', '.join(map(str, PROFILE_GAPS))}]) as limit_us) g),
per as (select limit_us, agent_id, s, sum(k) as n, max(t) - min(t) as d from cut group by all)
select limit_us::bigint as gap_us, count(*) as n_sessions, sum(n)::bigint as n_events, sum(d)::bigint as total_us,
  max(d)::bigint as longest_us from per group by limit_us""",
    "p4_found": f"""with recursive {_FOREST},
d as (select distinct n.id as s, trim(u, ' ' || chr(9) || chr(10) || chr(13)) as t
  from (select id, any_value(depends_on) as deps from notes group by id) n, unnest(deps) as x(u)),
e as (select s, t from d where t in (select id from n)),
reach(s, t) as (select s, t from e union select r.s, e.t from reach r join e on r.t = e.s)
select 'parent' as relation, n.id, coalesce(w.path[1], '(cycle)') as root_id, coalesce(w.depth, -1)::int as depth
  from n left join walk w using (id) where n.parent <> ''
union all select 'depends_on', s, '(cycle)', -1 from reach where s = t""",
    "p4_paths": f"""with recursive {_FOREST}
select id, coalesce(path[1], '(cycle)') as root_id, coalesce(depth, -1)::bigint as depth, array_to_string(path, '/') as path
from n left join walk using (id)""",
    "p4_descendants": f"""with recursive {_FOREST}
select a as ancestor, id as descendant, (depth + 1 - i)::bigint as distance
from (select id, depth, unnest(path) as a, generate_subscripts(path, 1) as i from walk) where i <= depth""",
}
