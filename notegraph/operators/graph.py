"""Edges between notes: extraction, log folding, health checks, readiness, levels, traversal and link changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.functions.scoring import age_days, disputed, recency, relevance, specificity, standing
from notegraph.operators.hierarchy import cycle_members
from notegraph.scratch import materialize, read, write


def edges_of(notes: DataFrame) -> DataFrame:
    """source, target, edge_type of all links, their index reverses, parents, and wiki links resolved or left as concepts.

    ``notes`` has id, the link lists, parent and body. An edge that a note lists twice comes out twice.
    """
    lists = F.array(*[F.struct(F.lit(t).alias("edge_type"), F.col(t).alias("targets")) for t in schema.LINK_TYPES])
    linked = notes.select("id", F.inline(lists)).select(F.col("id").alias("source"), F.explode("targets").alias("target"), "edge_type")
    out = linked
    for kind, reverse in schema.INDEX_REVERSE_LINKS.items():
        out = out.unionByName(
            linked.filter(F.col("edge_type") == kind).select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(reverse).alias("edge_type"))
        )
    child = notes.filter("parent is not null").select("id", "parent")
    out = out.unionByName(child.select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("child_of").alias("edge_type")))
    out = out.unionByName(child.select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("parent_of").alias("edge_type")))
    return out.unionByName(body_links(notes))


def body_links(notes: DataFrame) -> DataFrame:
    """source, target, edge_type: wiki links of the bodies, ``body_ref`` to a note and ``concept_ref`` to any other term."""
    found = notes.select(F.col("id").alias("source"), F.explode(tx.wiki_links(F.col("body"), F.col("id"))).alias("target"))
    known = notes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    kind = F.when(F.col("known"), "body_ref").otherwise("concept_ref")
    return found.join(known, "target", "left").select("source", "target", kind.alias("edge_type"))


def live_edges(log: DataFrame) -> DataFrame:
    """The edges of a log without those that any of its lines deletes, whatever their order; repeated lines are one."""
    key = ["source", "target", "edge_type"]
    return log.groupBy(*key).agg(F.bool_or(F.coalesce("deleted", F.lit(False))).alias("gone")).filter("not gone").select(*key)


def isolated(notes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return notes.join(ends, "id", "left_anti").select("id")


def dangling(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """source, target, edge_type, missing: the edges, other than to concepts, of which an end is no note."""
    known = notes.select("id").distinct()
    real = edges.filter("edge_type <> 'concept_ref'")
    marked = real.join(known.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left")
    marked = marked.join(known.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    missing = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return marked.select("source", "target", "edge_type", missing.alias("missing")).filter("missing is not null")


def links_in(notes: DataFrame) -> DataFrame:
    lists = F.array(*[F.struct(F.lit(t).alias("link_type"), F.col(t).alias("targets")) for t in schema.LINK_TYPES])
    return notes.select("id", F.inline(lists)).select("id", "link_type", F.posexplode("targets").alias("pos", "target"))


def broken_links(notes: DataFrame) -> DataFrame:
    """id, link_type, target, problem: links to no note; to another project's if its prefix is no prefix of these notes."""
    links = links_in(notes).select("id", "link_type", "target").distinct()
    missing = links.join(notes.select(F.col("id").alias("target")), "target", "left_anti")
    scopes = notes.select(tx.scope_of(F.col("id")).alias("scope"), F.lit(True).alias("own")).distinct()
    marked = missing.withColumn("scope", tx.scope_of(F.col("target"))).join(scopes, "scope", "left")
    return marked.select("id", "link_type", "target", F.when(F.col("own"), "broken_link").otherwise("cross_project_ref").alias("problem"))


def without_dead_links(notes: DataFrame) -> DataFrame:
    """id, link_type, kept, dropped: each link list without the targets that are no note, in its order."""
    links = links_in(notes).join(notes.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", "target"))))
    rows = links.groupBy("id", "link_type").agg(kept.alias("kept"), F.count("*").alias("n"))
    return rows.select("id", "link_type", F.array_join("kept.target", ",").alias("kept"), (F.col("n") - F.size("kept")).alias("dropped"))


def contradictions(notes: DataFrame) -> DataFrame:
    """a < b: pairs of notes that are in force and of which one contradicts the other."""
    live = notes.filter(~F.col("status").isin("deprecated", "archived"))
    pairs = live.select("id", F.explode("contradicts").alias("other")).filter("id <> other")
    pairs = pairs.join(live.select(F.col("id").alias("other")), "other", "left_semi")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def blocked_by(notes: DataFrame, kind: str = "depends_on") -> DataFrame:
    """(id): the notes from which a missing or live note can be reached over ``kind``.

    Found backwards, one frontier a round; beside it the pointers of notes with a single way on double, so that a chain takes
    rounds by the logarithm of its length. A pointer never passes a note that is blocked itself.
    """
    spark = notes.sparkSession
    steps = materialize(notes.select("id", F.explode(kind).alias("target")).distinct(), "steps")
    known = notes.select(F.col("id").alias("target"), F.col("status").isin(*schema.LIVE).alias("live"))
    first = steps.join(known, "target", "left").filter("live is null or live").select("id").distinct()
    done = [write(first, "blocked")]
    frontier = read(spark, done[0], first)
    single = steps.groupBy("id").agg(F.count("*").alias("n"), F.first("target").alias("to")).filter("n = 1").select("id", "to")
    ahead = materialize(single.join(first, "id", "left_anti"), "ahead")
    while not frontier.isEmpty():
        held = read(spark, done, first)
        back = steps.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi").select("id")
        jumped = ahead.join(held.withColumnRenamed("id", "to"), "to", "left_semi").select("id")
        done.append(write(back.unionByName(jumped).distinct().join(held, "id", "left_anti"), "blocked"))
        frontier = read(spark, done[-1], first)
        held = read(spark, done, first)
        rest = ahead.join(held, "id", "left_anti")
        further = rest.select(F.col("id").alias("to"), F.col("to").alias("next"))
        ahead = materialize(rest.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "ahead")
    return read(spark, done, first)


def ready(notes: DataFrame) -> DataFrame:
    """(id): active tasks whose dependencies, however far, all exist and are done; cycles of done notes do not block."""
    tasks = notes.filter("type = 'task' and status = 'active'").select("id")
    return tasks.join(blocked_by(notes), "id", "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """node, level: steps from the nearest source without predecessors over (source, target); nodes that none reaches have none."""
    spark = edges.sparkSession
    steps = materialize(edges.select("source", "target").distinct(), "steps")
    first = steps.select(F.col("source").alias("node")).distinct().join(steps.select(F.col("target").alias("node")), "node", "left_anti")
    first = first.select("node", F.lit(0).cast("bigint").alias("level"))
    done = [write(first, "levels")]
    frontier = read(spark, done[0], first)
    level = 0
    while not frontier.isEmpty():  # nodes reached are left out, so it ends on cycles too
        level += 1
        ahead = steps.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        ahead = ahead.join(read(spark, done, first).select("node"), "node", "left_anti").select("node", F.lit(level).cast("bigint").alias("level"))
        done.append(write(ahead, "levels"))
        frontier = read(spark, done[-1], first)
    return read(spark, done, first)


def traverse(seeds: DataFrame, notes: DataFrame, edges: DataFrame, as_of: str, cfg: schema.Scoring = schema.SCORING) -> DataFrame:
    """query_id, id, hop, score, rank: notes around the seeds (query_id, id, seed_pos) of many queries at once.

    Seeds are kept whatever they score. Each hop scores the unvisited neighbours of the last one; of the edges by which a
    note passes the threshold the first in order of (rank of the source, edge type) counts. Contradictions count against
    the notes visited in earlier hops.
    """
    columns = ("weight", "status", "origin", "type", "access_count", "last_accessed")
    known = materialize(notes.select("id", *columns), "known")
    in_force = known.filter("status <> 'deprecated'").select(F.col("id").alias("other"))
    disputes = edges.filter("edge_type = 'contradicts'").select(F.col("source").alias("id"), F.col("target").alias("other")).distinct()
    disputes = materialize(disputes.join(in_force, "other").select("id", "other"), "disputes")
    # the notes join the edges once, so each hop carries what the score needs of them: what it is without contradictions
    links = edges.filter("edge_type <> 'concept_ref'").select("source", F.col("target").alias("id"), "edge_type").distinct().join(known, "id")
    links = links.select("source", "id", "edge_type", standing(F.col("edge_type"), F.lit(0.0), cfg).alias("value"), recency(age_days(F.col("last_accessed"), as_of)).alias("factor"))
    if cfg.contradiction_penalty <= 0:  # contradictions don't raise a score, so what is under the threshold without them stays there
        links = links.filter(disputed(F.col("value"), F.lit(0), F.col("factor"), cfg) >= cfg.min_threshold)
    links = materialize(links.join(disputes.select("id", F.lit(True).alias("contested")).distinct(), "id", "left"), "links")

    def scored(rows: DataFrame, before: DataFrame) -> DataFrame:
        against = rows.filter("contested").select("query_id", "id").distinct().join(disputes, "id")
        hits = against.join(before.select("query_id", F.col("id").alias("other")), ["query_id", "other"]).groupBy("query_id", "id").agg(F.count("*").alias("hits"))
        full = rows.drop("contested").join(hits, ["query_id", "id"], "left").fillna(0, ["hits"])
        return full.withColumn("score", disputed(F.col("value"), F.col("hits"), F.col("factor"), cfg)).drop("value", "factor", "hits")

    start = seeds.select("query_id", "id", F.col("seed_pos").cast("bigint").alias("place"), F.lit("seed").alias("edge_type")).join(known, "id")
    start = start.withColumn("score", relevance(F.col("edge_type"), F.lit(0.0), F.lit(0), as_of, cfg))
    visited = materialize(start.select("query_id", "id", F.lit(0).alias("hop"), "place", "score"), "visited")
    frontier = visited
    for hop in range(1, cfg.max_hops + 1):
        near = frontier.select("query_id", F.col("id").alias("source"), F.col("place").alias("from_place")).join(links, "source").drop("source")
        near = near.join(visited.select("query_id", "id"), ["query_id", "id"], "left_anti")
        passed = scored(near, visited).filter(F.col("score") >= cfg.min_threshold)
        order = Window.partitionBy("query_id", "id").orderBy("from_place", "edge_type")
        first = passed.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("from_place", "edge_type", "id")).cast("bigint")
        frontier = materialize(first.select("query_id", "id", F.lit(hop).alias("hop"), place.alias("place"), "score"), "hop")
        visited = visited.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return visited.select("query_id", "id", "hop", "score", rank.alias("rank")).filter(F.col("rank") <= cfg.max_results)


def disputed_within(results: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """query_id, id, disputed: how many others of a result (query_id, id) a note contradicts; deprecated notes do not count."""
    live = notes.filter("status <> 'deprecated'").select("id")
    held = results.select("query_id", "id").distinct().join(live, "id")
    against = edges.filter("edge_type = 'contradicts' and source <> target").select(F.col("source").alias("id"), F.col("target").alias("other")).distinct()
    met = held.join(against, "id").join(held.select("query_id", F.col("id").alias("other")), ["query_id", "other"])
    return met.groupBy("query_id", "id").agg(F.count("*").alias("disputed"))


def apply_links(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """id, link_type, target to add for requests (source, target, link_type): the link, and its symmetric or inverse side.

    Requests of unknown type, to itself or with an end that is no note do not count; links that exist are not added again.
    """
    valid = requests.filter(F.col("link_type").isin(*schema.LINK_TYPES) & (F.col("source") != F.col("target"))).distinct()
    known = notes.select("id")
    valid = valid.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    inverse = reverse_of(F.col("link_type"))
    both = valid.select(F.col("source").alias("id"), "link_type", "target").unionByName(
        valid.select(F.col("target").alias("id"), inverse.alias("link_type"), F.col("source").alias("target")).filter("link_type is not null")
    )
    present = links_in(notes).select("id", "link_type", "target")
    return both.distinct().join(present, ["id", "link_type", "target"], "left_anti")


def reverse_of(kind: Column) -> Column:
    """The type of the link that the other end gets: the same for symmetric types, the inverse, else null."""
    other = F.when(kind.isin(*schema.SYMMETRIC_LINKS), kind)
    for name, inverse in schema.INVERSE_LINKS.items():
        other = other.when(kind == name, inverse)
    return other


def link_effects(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """effect, id, link_type, target of all that requests (source, target, link_type) bring about.

    ``link``: a link that a note's list gains, ``edge``: an edge that the log gains (with the reverse of builds_on), ``status``:
    a superseded note that becomes deprecated, by ``target``. Requests that do not count are those of ``apply_links``.
    """
    valid = requests.filter(F.col("link_type").isin(*schema.LINK_TYPES) & (F.col("source") != F.col("target"))).select("source", "link_type", "target").distinct()
    known = notes.select("id").distinct()
    valid = valid.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    index_reverse = F.lit(None).cast("string")
    for kind, other in schema.INDEX_REVERSE_LINKS.items():
        index_reverse = F.when(F.col("link_type") == kind, other).otherwise(index_reverse)
    sides = F.array(
        F.struct(F.lit("edge").alias("effect"), F.col("source").alias("id"), F.col("link_type"), F.col("target")),
        F.struct(F.lit("edge").alias("effect"), F.col("target").alias("id"), reverse_of(F.col("link_type")).alias("link_type"), F.col("source").alias("target")),
        F.struct(F.lit("edge").alias("effect"), F.col("target").alias("id"), index_reverse.alias("link_type"), F.col("source").alias("target")),
        F.struct(F.lit("status").alias("effect"), F.col("target").alias("id"), F.when(F.col("link_type") == "supersedes", F.lit("deprecated")).alias("link_type"), F.col("source").alias("target")),
    )
    effects = valid.select(F.inline(sides)).filter("link_type is not null").distinct()
    return effects.unionByName(apply_links(notes, valid).select(F.lit("link").alias("effect"), "id", "link_type", "target"))


def new_edges(log: DataFrame, asked: DataFrame) -> DataFrame:
    """source, target, edge_type, deleted: lines to append to the log so that the asked edges are live; those that are add none."""
    key = ["source", "target", "edge_type"]
    return asked.select(*key).dropna().distinct().join(live_edges(log), key, "left_anti").withColumn("deleted", F.lit(False))


def tombstones(log: DataFrame, gone: DataFrame) -> DataFrame:
    """source, target, edge_type, deleted: lines to append so that the given edges are gone; those that are not live add none."""
    key = ["source", "target", "edge_type"]
    return live_edges(log).join(gone.select(*key).distinct(), key, "left_semi").withColumn("deleted", F.lit(True))


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of which an end is among the ids (id)."""
    gone = ids.select("id").distinct()
    from_ = edges.join(gone.select(F.col("id").alias("source")), "source", "left_semi").select(*edges.columns)
    to = edges.join(gone.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)
    return from_.unionByName(to).distinct()


def moved_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """source, edge_type, target that the edges of merged notes become, from members (id, merged).

    Edges inside one cluster and supersedes edges do not move, and edges of which no end is merged are not listed.
    """
    links = edges.filter(F.col("edge_type").isin(*[t for t in schema.LINK_TYPES if t != "supersedes"]))
    s = members.select(F.col("id").alias("source"), F.col("merged").alias("s"))
    t = members.select(F.col("id").alias("target"), F.col("merged").alias("t"))
    both = links.join(s, "source", "left").join(t, "target", "left").filter("(s is not null or t is not null) and not (s <=> t)")
    moved = both.select(F.coalesce("s", "source").alias("source"), "edge_type", F.coalesce("t", "target").alias("target"))
    return moved.filter("source <> target").distinct()


def degree_summary(edges: DataFrame) -> DataFrame:
    """edge_type, n, sources, targets, most: size and spread of each kind of edge."""
    per_source = edges.groupBy("edge_type", "source").agg(F.count("*").alias("k"))
    targets = edges.select("edge_type", "target").distinct().groupBy("edge_type").agg(F.count("*").alias("targets"))
    return per_source.groupBy("edge_type").agg(F.sum("k").alias("n"), F.count("*").alias("sources"), F.max("k").alias("most")).join(targets, "edge_type")


def chains(notes: DataFrame, starts: DataFrame) -> DataFrame:
    """id, node, level: what stands around each start (id): steps back over depends_on as negative levels, on over blocks as
    positive ones; a node on both sides has the nearer level, of equally near ones the negative. Ends that are no note have none.
    """
    spark = notes.sparkSession
    known = notes.select(F.col("id").alias("node"))
    found = None
    for kind, sign in (("depends_on", -1), ("blocks", 1)):
        steps = materialize(notes.select(F.col("id").alias("at"), F.explode(kind).alias("node")).distinct(), "steps")
        first = starts.select("id", F.col("id").alias("node"), F.lit(0).cast("bigint").alias("level"))
        done = [write(first, "chain")]
        ahead, level = read(spark, done[0], first), 0
        while not ahead.isEmpty():
            level += sign
            near = ahead.select("id", F.col("node").alias("at")).join(steps, "at").select("id", "node").distinct()
            near = near.join(read(spark, done, first).select("id", "node"), ["id", "node"], "left_anti")
            done.append(write(near.withColumn("level", F.lit(level).cast("bigint")), "chain"))
            ahead = read(spark, done[-1], first)
        side = read(spark, done, first)
        found = side if found is None else found.unionByName(side)
    nearest = F.min(F.struct(F.abs("level").alias("far"), F.col("level")))
    return found.join(known, "node", "left_semi").groupBy("id", "node").agg(nearest.alias("l")).select("id", "node", F.col("l.level").alias("level"))


def edge_scores(edges: DataFrame, notes: DataFrame, log: DataFrame, as_of: str, cfg: schema.Scoring = schema.SCORING) -> DataFrame:
    """source, id, edge_type, score of the target of each edge, with the edge's bonus, the specificity of its own tags as matched
    ones, and a penalty for each note in force that it contradicts (by the edges of ``log``)."""
    tags = notes.select("id", F.explode("tags").alias("tag"))
    per_tag = tags.groupBy("tag").agg(specificity(F.count("*")).alias("s"))
    matched = tags.join(per_tag, "tag").groupBy("id").agg(F.avg("s").alias("matched"))
    live = notes.filter("status <> 'deprecated'").select(F.col("id").alias("target"))
    against = log.filter("edge_type = 'contradicts'").select(F.col("source").alias("id"), "target").distinct().join(live, "target").groupBy("id").agg(F.count("*").alias("disputed"))
    full = notes.join(matched, "id", "left").join(against, "id", "left").fillna(0.0, ["matched"]).fillna(0, ["disputed"])
    rows = edges.select("source", F.col("target").alias("id"), "edge_type").join(full, "id")
    return rows.select("source", "id", "edge_type", relevance(F.col("edge_type"), F.col("matched"), F.col("disputed"), as_of, cfg).alias("score"))


def shortest_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, cycle: for each node that can reach itself a shortest cycle through it, as an array that starts with its smallest node.

    Paths grow by one step a round, from the nodes on cycles and over edges between them, and are kept once for each pair of
    start and end.
    """
    on = materialize(cycle_members(edges, nodes), "on-cycles")
    arcs = edges.select("source", "target").distinct().join(on.select(F.col("id").alias("source")), "source", "left_semi")
    arcs = materialize(arcs.join(on.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target"), "arcs")
    paths = materialize(arcs.select(F.col("source").alias("start"), F.col("target").alias("node"), F.array("source").alias("path")), "paths")
    seen, closed = paths.select("start", "node"), []
    while True:
        found = paths.filter("start = node").select("start", "path")
        closed.append(found)
        done = closed[0]
        for more in closed[1:]:
            done = done.unionByName(more)
        open_ = paths.join(done.select("start").distinct(), "start", "left_anti")
        longer = open_.join(arcs, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), F.concat("path", F.array("node")).alias("path"))
        longer = longer.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti")
        paths = materialize(longer.select("start", "node", "path"), "paths")
        if paths.isEmpty():
            break
        seen = seen.unionByName(paths.select("start", "node"))
    smallest = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", smallest, F.size("path")), F.slice("path", F.lit(1), smallest - 1))
    return done.groupBy("start").agg(F.min("path").alias("path")).select(F.col("start").alias("id"), turned.alias("cycle"))
