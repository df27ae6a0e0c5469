"""Hierarchies from parent links, and the members of cycles of a directed graph, by tree contraction.

Each round rakes the leaves and splices an independent set of unary nodes out of their chains, recording for every
removed node the surviving node it hung from; a constant share of the nodes goes each round, so the number of rounds
grows with the logarithm of the input whatever the depth. The recorded rounds are then replayed backwards to hand roots,
depths and paths down. What no round can remove is a self-loop: the core of a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from notegraph.scratch import materialize, read, write
from notegraph.sources.tables import trimmed

CYCLE = "(cycle)"


def _priority(node: Column, r: int) -> Column:
    return F.xxhash64(node, F.lit(r))


def _written(node: Column) -> Column:
    """An id as it stands in a path: ``/`` and ``%`` in it are written ``%2F`` and ``%25``."""
    return F.replace(F.replace(node, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def _unwritten(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def _numbered(nodes: DataFrame) -> DataFrame:
    """(id, num) of the distinct trimmed ids: contraction works on numbers, ids come back at the end."""
    known = nodes.select(trimmed(F.col("id")).alias("id")).filter("id <> ''").distinct()
    return materialize(known.select("id", F.monotonically_increasing_id().alias("num")), "nodes")


def contract(links: DataFrame, with_paths: bool = False) -> tuple[list[str], DataFrame, list[str]]:
    """Contract (id, parent) links; the last node of a walk has no row. Returns the records of each round, their schema, the cores.

    A record (id, parent, dist) says that ``id`` is ``dist`` steps below ``parent``, which outlives it. ``with_paths`` the links
    have the node's name too, and a record also has ``via``, the names of the nodes between joined by ``/``.
    """
    spark = links.sparkSession
    own = ["name", "via"] if with_paths else []
    alive = links.select("id", "parent", F.lit(1).cast("bigint").alias("dist"), *([F.col("name"), F.lit("").alias("via")] if with_paths else []))
    rounds: list[str] = []
    cores: list[str] = []
    shape = None
    r = 0
    while True:
        kids = alive.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_kids"), F.max("id").alias("kid"))
        state = alive.join(kids, "id", "left")
        loop = F.col("parent") == F.col("id")
        lowest = (_priority(F.col("id"), r) < _priority(F.col("parent"), r)) & (
            _priority(F.col("id"), r) < _priority(F.col("kid"), r)
        )
        act = (
            F.when(F.col("n_kids").isNull(), "rake")
            .when((F.col("n_kids") == 1) & ~loop & lowest, "splice")
            .otherwise("keep")
        )
        state = state.withColumn("act", act)
        lift = state.filter("act = 'splice'").select(
            F.col("kid").alias("id"), F.col("parent").alias("up"), F.col("dist").alias("more"),
            *([F.concat_ws("/", F.nullif("via", F.lit("")), "name").alias("up_via")] if with_paths else []),
        )
        state = state.join(lift, "id", "left")
        if with_paths:
            longer = F.concat_ws("/", "up_via", F.nullif("via", F.lit("")))
            state = state.withColumn("via", F.when(F.col("up").isNotNull(), longer).otherwise(F.col("via")))
        state = state.select(
            "id", F.coalesce("up", "parent").alias("parent"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), *own, "act"
        )
        state = state.withColumn("act", F.when((F.col("act") == "keep") & (F.col("parent") == F.col("id")), "core").otherwise(F.col("act")))
        seen = Observation()
        counted = state.observe(
            seen, F.count(F.when(F.col("act") == "keep", 1)).alias("kept"), F.count(F.when(F.col("act") == "core", 1)).alias("cores")
        )
        path = write(counted, f"contract-{r}")
        shape = state
        rounds.append(path)
        if seen.get["cores"]:
            cores.append(path)
        if not seen.get["kept"]:
            return rounds, shape, cores
        alive = read(spark, path, shape).filter("act = 'keep'").drop("act")
        r += 1


def hierarchy(links: DataFrame, nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root, depth and path of every node of ``nodes`` (id) over ``links`` (id, parent).

    Returns id, root_id, depth and, ``with_paths``, path: the ids from the root to the node joined by ``/`` (a ``/`` or ``%``
    in an id is written ``%2F`` or ``%25``). A parent that is no node ends the walk below it. A node whose walk never ends has
    root ``(cycle)``, depth -1 and a null path. Ids are compared trimmed; null or empty ids and parents do not count; of
    several parents of an id the smallest counts, and repeated rows are one. Other columns are ignored. No nodes give no rows.
    """
    spark = nodes.sparkSession
    known = _numbered(nodes)
    pairs = links.select(trimmed(F.col("id")).alias("id"), trimmed(F.col("parent")).alias("parent"))
    pairs = pairs.filter("id <> '' and parent <> ''").groupBy("id").agg(F.min("parent").alias("parent"))
    pairs = pairs.join(known, "id").select("parent", F.col("num").alias("child"), *([_written(F.col("id")).alias("name")] if with_paths else []))
    above = known.select(F.col("id").alias("parent"), "num")
    inner = pairs.join(above, "parent").select(F.col("child").alias("id"), F.col("num").alias("parent"), *(["name"] if with_paths else []))
    inner = materialize(inner, "links")
    rounds, shape, cores = contract(inner, with_paths)

    # tops without children need no round
    tops = inner.select(F.col("parent").alias("num")).distinct().join(inner.select(F.col("id").alias("num")), "num", "left_anti").join(known, "num")
    tops = tops.select(
        F.col("num").alias("id"), F.col("id").alias("root_id"), F.lit(0).cast("bigint").alias("depth"),
        (_written(F.col("id")) if with_paths else F.lit(None).cast("string")).alias("path"),
    )
    done = [write(tops, "tops")]
    if cores:
        looped = read(spark, cores, shape).filter("act = 'core'").select(
            "id", F.lit(CYCLE).alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("path")
        )
        done.append(write(looped, "cores"))
    for path in reversed(rounds):
        record = read(spark, path, shape).filter("act in ('rake', 'splice')")
        above = read(spark, done, tops).withColumnRenamed("id", "parent")
        whole = F.concat_ws("/", "path", F.nullif("via", F.lit("")), "name") if with_paths else F.col("path")
        step = record.join(above, "parent").select(
            "id", "root_id", F.when(F.col("depth") < 0, -1).otherwise(F.col("depth") + F.col("dist")).alias("depth"),
            F.when(F.col("path").isNotNull(), whole).alias("path"),
        )
        done.append(write(step, "expand"))
    solved = known.join(read(spark, done, tops).withColumnRenamed("id", "num"), "num", "left")
    alone = F.col("root_id").isNull()
    path = F.when(alone, _written(F.col("id"))).otherwise(F.col("path"))
    return solved.select(
        "id", F.coalesce("root_id", "id").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("depth"), *([path.alias("path")] if with_paths else [])
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node below every node, from the paths of ``hierarchy``; cycles give none."""
    parts = paths.filter("path is not null").select("id", F.transform(F.split("path", "/"), _unwritten).alias("parts"))
    above = parts.select("id", F.size("parts").alias("n"), F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("at", "ancestor"))
    return above.select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance"))


def _marked(edges: DataFrame, r: int) -> DataFrame:
    """Per node of the edges: rake it (no way in or no way out), splice it (one of each, lowest of its neighbours), or keep it."""
    sides = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("id"), F.col("target").alias("succ"), F.lit(None).cast("bigint").alias("pred")),
                F.struct(F.col("target").alias("id"), F.lit(None).cast("bigint").alias("succ"), F.col("source").alias("pred")),
            )
        ).alias("side")
    ).select("side.*")
    degree = sides.groupBy("id").agg(
        F.count("succ").alias("n_out"), F.count("pred").alias("n_in"), F.max("succ").alias("succ"), F.max("pred").alias("pred")
    )
    mine = _priority(F.col("id"), r)
    unary = (F.col("n_out") == 1) & (F.col("n_in") == 1)
    lowest = (mine < _priority(F.col("succ"), r)) & (mine < _priority(F.col("pred"), r))
    return degree.select(
        "id", "pred", "succ",
        F.when((F.col("n_out") == 0) | (F.col("n_in") == 0), "rake").when(unary & lowest, "splice").otherwise("keep").alias("act"),
    )


def _colored(edges: DataFrame) -> DataFrame:
    """(id, color) of the ends of the edges: the largest number from which the node can be reached, itself included.

    Each round takes the colors of the nodes before and that of the node the own color names, which doubles how far colors
    have come along a chain.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    color = materialize(nodes.select("id", F.col("id").alias("color")), "color")
    while True:
        sent = edges.join(color, edges["source"] == color["id"]).select(F.col("target").alias("id"), "color", F.lit(None).cast("bigint").alias("old"))
        named = color.select(F.col("id").alias("at"), F.col("color").alias("further"))
        own = color.join(named, F.col("color") == F.col("at")).select("id", F.col("further").alias("color"), F.col("color").alias("old"))
        best = own.unionByName(sent).groupBy("id").agg(F.max("color").alias("color"), F.max("old").alias("old"))
        moved = Observation()
        best = best.observe(moved, F.count(F.when(F.col("color") != F.col("old"), 1)).alias("n"))
        color = materialize(best.select("id", "color"), "color")
        if not moved.get["n"]:
            return color


def _components(edges: DataFrame) -> DataFrame:
    """(id, scc) of the nodes of a core (source, target).

    Colors split the nodes by the largest number before them; within a color, what reaches that number is one component, and
    the rest goes on. Each round numbers the nodes in another random order, so that chains of nodes and of components with
    rising numbers, over which colors come step by step, are short.
    """
    out: DataFrame | None = None
    k = 0
    while not edges.isEmpty():
        k += 1
        nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("h", F.xxhash64("id", F.lit(k)))
        order = nodes.repartitionByRange("h").sortWithinPartitions("h").select("id", F.monotonically_increasing_id().alias("num"))
        order = materialize(order, "order")
        turned = edges.join(order.select(F.col("id").alias("source"), F.col("num").alias("s")), "source")
        turned = turned.join(order.select(F.col("id").alias("target"), F.col("num").alias("t")), "target")
        turned = materialize(turned.select("source", "target", "s", "t"), "turned")
        ahead = _colored(turned.select(F.col("s").alias("source"), F.col("t").alias("target")))
        inside = turned.join(ahead.select(F.col("id").alias("s"), F.col("color").alias("s_color")), "s")
        inside = inside.join(ahead.select(F.col("id").alias("t"), F.col("color").alias("t_color")), "t")
        inside = materialize(inside.filter("s_color = t_color").select("source", "target", "s", "t"), "inside")
        back = _colored(inside.select(F.col("t").alias("source"), F.col("s").alias("target")))
        both = ahead.join(back.select("id", F.col("color").alias("back")), "id", "left")
        found = both.filter(F.coalesce("back", "id") == F.col("color")).select(F.col("id").alias("num"), "color")
        found = found.join(order, "num").select("id", "color").join(order.select(F.col("num").alias("color"), F.col("id").alias("scc")), "color")
        found = materialize(found.select("id", "scc"), "found")
        out = found if out is None else out.unionByName(found)
        # a component never lies in two colors, so only edges inside one go on
        rest = inside.select("source", "target").join(found.select(F.col("id").alias("source")), "source", "left_anti")
        edges = materialize(rest.join(found.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"), "core")
    return out


def cycle_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): the nodes that can reach themselves over ``edges`` (source, target); ends that are no node of ``nodes`` (id) lead nowhere.

    Nodes without a way in or out are raked and unary nodes spliced out of their chains until neither applies. A self-loop
    marks its node; of a core without any, the strongly connected components are taken. A spliced node lies on a cycle if
    the two ends it was spliced between are in one component. Repeated edges, nulls, blanks around ids and further columns
    do no harm; no edges give no rows.
    """
    known = _numbered(nodes)
    arcs = edges.select(trimmed(F.col("source")).alias("a"), trimmed(F.col("target")).alias("b"))
    arcs = arcs.filter("a <> '' and b <> ''").distinct()
    arcs = arcs.join(known.select(F.col("id").alias("a"), F.col("num").alias("source")), "a")
    arcs = arcs.join(known.select(F.col("id").alias("b"), F.col("num").alias("target")), "b")
    alive = materialize(arcs.select("source", "target", F.lit(None).cast("bigint").alias("spliced")), "arcs")
    steps = [alive]
    r = 0
    while True:
        edges = alive.filter("source <> target").select("source", "target").distinct()
        marks = _marked(edges, r)
        both = edges.join(marks.select(F.col("id").alias("source"), F.col("act").alias("act_s")), "source")
        both = both.join(marks.select(F.col("id").alias("target"), F.col("act").alias("act_t"), F.col("succ").alias("past")), "target")
        seen = Observation()
        both = both.observe(
            seen, F.count("*").alias("n"), F.count(F.when((F.col("act_s") != "keep") | (F.col("act_t") != "keep"), 1)).alias("touched")
        )
        # the way into a spliced node now leads to its successor; an end raked at the same time goes in the next round
        cut = F.col("act_t") == "splice"
        kept = both.filter((F.col("act_s") == "keep") & (F.col("act_t") != "rake"))
        rest = kept.select("source", F.when(cut, F.col("past")).otherwise(F.col("target")).alias("target"), F.when(cut, F.col("target")).alias("spliced"))
        rest = materialize(rest, f"arcs-{r}")
        if not seen.get["touched"]:
            break
        alive = rest
        steps.append(rest)
        r += 1
    loops = [step.filter("source = target").select(F.col("source").alias("id")) for step in steps]
    spliced = [step.filter("spliced is not null").select(F.col("spliced").alias("id"), F.col("source").alias("pred"), F.col("target").alias("succ")) for step in steps[1:]]
    core = rest.select("source", "target")
    # (id, scc) of the nodes that share a component with another; any other node is its own component
    scc = None
    found = loops[0]
    for more in loops[1:]:
        found = found.unionByName(more)
    if seen.get["n"]:
        scc = _components(core)
        shared = scc.groupBy("scc").count().filter("count > 1").select("scc")
        scc = materialize(scc.join(shared, "scc", "left_semi").select("id", "scc"), "scc")
        found = found.unionByName(scc.select("id"))
    for cut in reversed(spliced):
        own = F.col("pred")
        if scc is None:
            hit = cut.filter("pred = succ").select("id", own.alias("scc"))
        else:
            a = scc.select(F.col("id").alias("pred"), F.col("scc").alias("a"))
            b = scc.select(F.col("id").alias("succ"), F.col("scc").alias("b"))
            both = cut.join(a, "pred", "left").join(b, "succ", "left")
            a, b = F.coalesce("a", "pred"), F.coalesce("b", "succ")
            hit = both.filter(a == b).select("id", a.alias("scc"))
        met = Observation()
        hit = materialize(hit.observe(met, F.count("*").alias("n")), "unsplice")
        if met.get["n"]:
            found = found.unionByName(hit.select("id"))
            scc = hit if scc is None else scc.unionByName(hit)
    return found.distinct().withColumnRenamed("id", "num").join(known, "num").select("id")
