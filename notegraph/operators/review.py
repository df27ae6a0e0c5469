"""Review of proposals from several runs or lenses: keys, voting, merging, agreement, confidence and change detection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions.text import title_of
from notegraph.operators import graph
from notegraph.operators.order import numbered

_SEVERITY = {"low": 1, "medium": 2, "high": 3}


def proposal_key() -> Column:
    """What makes proposals of different runs the same: kind, action, sorted sources, and for links the targets and link type."""
    key = F.concat_ws("|", "kind", "action", F.array_join(F.array_sort("sources"), ","))
    link = F.concat_ws("|", key, F.array_join(F.array_sort("targets"), ","), F.coalesce("link_type", F.lit("")))
    return F.when(F.col("kind") == "link_suggestion", link).otherwise(key)


def vote(proposals: DataFrame, n_runs: int, share: float = 0.5) -> DataFrame:
    """key, votes, agreement, severity, rationale, sources, targets of the proposals that more than ``share`` of the runs made.

    The highest severity and the longest rationale count (the smaller of equally long ones); sources and targets are united.
    Members are reduced to distinct ids before they are gathered.
    """
    rows = proposals.withColumn("key", proposal_key())
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _SEVERITY.items() for x in p]), F.col("severity")), F.lit(0))
    groups = rows.groupBy("key").agg(
        F.count("*").alias("votes"), F.max_by("severity", F.struct(rank, "severity")).alias("severity"),
        F.max(F.struct(F.octet_length("rationale").alias("n"), F.col("rationale"))).alias("longest"),
    )
    kept = groups.filter(F.col("votes") >= int(n_runs * share) + 1)

    def united(name: str) -> DataFrame:
        ids = rows.join(kept.select("key"), "key", "left_semi").select("key", F.explode(name).alias("id")).distinct()
        return ids.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias(name))

    out = kept.join(united("sources"), "key", "left").join(united("targets"), "key", "left")
    said = F.concat(F.lit("["), F.col("votes"), F.lit(f"/{n_runs} runs agreed] "), F.col("longest.rationale"))
    return out.select(
        "key", "votes", (F.col("votes") / n_runs).alias("agreement"), "severity", said.alias("rationale"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("targets", F.lit("")).alias("targets"),
    )


def cross_lens(proposals: DataFrame) -> DataFrame:
    """key, lenses: the sorted lenses of each key that at least two of them found."""
    pairs = proposals.select(proposal_key().alias("key"), "lens").filter("lens <> ''").distinct()
    found = pairs.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("lens")), ",").alias("lenses"))
    return found.filter("n >= 2").select("key", "lenses")


def history_score(total: Column, checked: Column, persisted: Column, positive_pct: Column, avg_delta: Column) -> Column:
    kept = F.when(checked > 0, persisted / checked).otherwise(0.5)
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), avg_delta + 0.5))
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.5).otherwise((kept + F.least(positive_pct / 100, F.lit(1.0)) + gain) / 3.0)


def confidence(history: Column, structure: Column, severity: Column, quality: Column, agreement: Column) -> Column:
    """Weighted sum of the five parts, kept between 0 and 1."""
    weight = F.when(severity == "high", 0.9).when(severity == "medium", 0.6).when(severity == "low", 0.3).otherwise(0.5)
    total = history * 0.35 + structure * 0.20 + weight * 0.15 + quality * 0.10 + agreement * 0.20
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, state of (key, hash) tables: added, removed, changed or same. Repeated rows of a key are one."""
    was = old.groupBy("key").agg(F.min("hash").alias("was"))
    now = new.groupBy("key").agg(F.min("hash").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return was.join(now, "key", "full").select("key", state.alias("state"))


def to_scan(old: DataFrame, new: DataFrame) -> DataFrame:
    """The keys of (key, hash) that a scan has to look at: the changed and added ones, or all if nothing has changed."""
    states = changed_rows(old, new).filter("state <> 'removed'")
    fresh = states.filter("state <> 'same'")
    return states.select("key") if fresh.isEmpty() else fresh.select("key")


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """first, copies: of rows with equal keys the first by ``order``, and how many there are."""
    return rows.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("copies")).select("first", "copies")


def lens_members(proposals: DataFrame) -> DataFrame:
    """The proposals with ``lenses``: the sorted lenses of their key if at least two found it, else an empty array."""
    keyed = proposals.withColumn("key", proposal_key())
    agreed = cross_lens(proposals).withColumnRenamed("lenses", "_lenses")
    return keyed.join(agreed, "key", "left").withColumn("lenses", F.coalesce(F.split("_lenses", ","), F.array().cast("array<string>"))).drop("_lenses")


def valid_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with a kind, a rationale and at least one source; an absent severity is medium."""
    kept = proposals.filter("coalesce(kind, '') <> '' and coalesce(rationale, '') <> '' and size(sources) > 0")
    return kept.withColumn("severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium")))


def structure_score() -> Column:
    """Share of the fields that a proposal of its kind should have and has."""
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    has = {c: one(F.coalesce(c, F.lit("")) != "") for c in ("kind", "action", "rationale", "link_type")}
    n = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("sources", "targets", "tags")}
    said = F.octet_length(F.coalesce("rationale", F.lit("")))
    base = has["kind"] + has["action"] + has["rationale"] + F.when(said > 50, 0.5).otherwise(0.0)
    own = {
        "link_suggestion": (one(n["sources"] > 0) + one(n["targets"] > 0) + has["link_type"], 3),
        "contradiction": (one(n["sources"] >= 2), 1),
        "tag_refinement": (one(n["sources"] > 0) + one(n["tags"] > 0), 2),
        "staleness": (one(n["sources"] > 0), 1),
        "compression": (one(n["sources"] > 0) + one(said > 100), 2),
        "signal": (has["action"] + one(n["tags"] > 0), 2),
        "merge_suggestion": (one(n["sources"] >= 3) + one(n["tags"] > 0) + one(said > 100), 3),
    }
    score = F.lit(None).cast("double")
    for kind, (filled, total) in own.items():
        score = F.when(F.col("kind") == kind, (base + filled) / (3.5 + total)).otherwise(score)
    return F.coalesce(score, (base + one(n["sources"] > 0)) / 4.5)


def affected(proposals: DataFrame) -> DataFrame:
    """pid, id: the distinct notes that a proposal names."""
    both = F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("targets", F.array().cast("array<string>")))
    return proposals.select("pid", F.explode(F.array_distinct(both)).alias("id"))


def quality(proposals: DataFrame, scores: DataFrame) -> DataFrame:
    """pid, quality: half the mean score (id, score) of the notes a proposal names, between 0 and 1; 0.5 without any."""
    mean = affected(proposals).join(scores.select("id", "score"), "id").groupBy("pid").agg(F.avg("score").alias("mean"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") / 2))
    return proposals.select("pid").join(mean, "pid", "left").select("pid", F.coalesce(part, F.lit(0.5)).alias("quality"))


def _first(name: str, i: int = 0) -> Column:
    return F.get(name, F.lit(i))


def persisted(proposals: DataFrame, notes: DataFrame, edges: DataFrame) -> DataFrame:
    """pid, persisted: whether what an applied proposal did still holds, by kind; other kinds always do.

    ``notes`` has id, status, tags; ``edges`` are the live ones. A proposal that lacks what its kind needs has not persisted.
    """
    want = F.when(F.col("kind") == "link_suggestion", F.struct(_first("sources").alias("s"), _first("targets").alias("t"), F.col("link_type").alias("k")))
    want = want.when(F.col("kind") == "contradiction", F.struct(_first("sources").alias("s"), _first("sources", 1).alias("t"), F.lit("contradicts").alias("k")))
    rows = proposals.select("pid", "kind", "sources", "tags", want.alias("w")).select("*", F.col("w.s").alias("_s"), F.col("w.t").alias("_t"), F.col("w.k").alias("_k"))
    live = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("edge_type").alias("_k"), F.lit(True).alias("linked")).distinct()
    first = notes.select(F.col("id").alias("_f"), F.col("status").alias("f_status"), F.col("tags").alias("f_tags"))
    rows = rows.join(live, ["_s", "_t", "_k"], "left").withColumn("_f", _first("sources")).join(first, "_f", "left")
    ends = proposals.filter("kind = 'merge_suggestion'").select("pid", F.explode(F.array_distinct("sources")).alias("id"))
    ends = ends.join(notes.select("id", "status"), "id", "left").groupBy("pid").agg(F.bool_and(F.coalesce(F.col("status") == "deprecated", F.lit(False))).alias("gone"))
    kept_tags = (F.size("tags") > 0) & F.col("f_tags").isNotNull() & (F.size(F.array_except("tags", "f_tags")) == 0)
    holds = (
        F.when(F.col("kind").isin("link_suggestion", "contradiction"), F.coalesce("linked", F.lit(False)))
        .when(F.col("kind") == "staleness", F.coalesce(F.col("f_status") == "deprecated", F.lit(False)))
        .when(F.col("kind") == "tag_refinement", F.coalesce(kept_tags, F.lit(False)))
        .when(F.col("kind") == "compression", F.col("f_tags").isNotNull())
        .when(F.col("kind") == "constellation", F.size("sources") > 0)
        .when(F.col("kind") == "merge_suggestion", F.coalesce("gone", F.lit(True)))
        .otherwise(True)
    )
    return rows.join(ends, "pid", "left").select("pid", holds.alias("persisted"))


def score_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """pid, delta: mean change of the scores (pid, id, score) against those of now (id, score); notes that are gone do not count."""
    both = before.join(now.select("id", F.col("score").alias("post")), "id")
    return both.groupBy("pid").agg(F.avg(F.col("post") - F.col("score")).alias("delta"))


def applied_effects(proposals: DataFrame, notes: DataFrame, edges: DataFrame) -> DataFrame:
    """effect, id, name, value of applying proposals, for each kind what it changes; proposals that lack what they need do nothing.

    ``note``: a new note (name: type, value: title); ``set``: a field of a note (name) gets a value; ``link``, ``edge`` and
    ``status`` as in ``link_effects``; ``body_ref``: a link written into a body; ``signal``: a new signal (id, name: tags).
    ``proposals`` has pid, kind, action, sources, targets, link_type, rationale, tags. New notes have the id ``new-`` and pid.
    """
    row = proposals.withColumn("n", F.coalesce(F.size("sources"), F.lit(0))).withColumn("hub", F.concat(F.lit("new-"), "pid")).withColumn("said", F.coalesce("rationale", F.lit("")))
    alias = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in schema.ADVISORY_LINKS.items() for x in p]), F.col("link_type")), F.col("link_type"))
    direct = row.filter("kind = 'link_suggestion'").select(_first("sources").alias("source"), _first("targets").alias("target"), alias.alias("link_type"))
    against = row.filter("kind = 'contradiction' and n >= 2").select(_first("sources").alias("source"), _first("sources", 1).alias("target"), F.lit("contradicts").alias("link_type"))
    makes = {
        "constellation": ("n > 0 and size(tags) > 0", "relates_to", F.lit("constellation"), F.concat(F.lit("Constellation: "), _first("tags"))),
        "merge_suggestion": ("n >= 3 and said <> ''", "supersedes", None, title_of(F.col("said"))),
        "summarize": ("n >= 3 and said <> ''", "builds_on", F.lit("context"), title_of(F.col("said"))),
    }
    ends = row.select("pid", "hub", "kind", F.explode("sources").alias("id")).distinct().join(notes.select("id", "type"), "id")
    top = ends.filter("kind = 'merge_suggestion'").groupBy("pid", "type").agg(F.count("*").alias("c")).groupBy("pid").agg(F.max_by("type", F.struct("c", F.col("type"))).alias("major"))
    hubs, hub_links = [], []
    for kind, (test, link, of, title) in makes.items():
        made = row.filter(F.col("kind") == kind).filter(test)
        typed = made.join(top, "pid", "left").withColumn("of", F.coalesce("major", F.lit("lesson"))) if of is None else made.withColumn("of", of)
        hubs.append(typed.select(F.lit("note").alias("effect"), F.col("hub").alias("id"), F.col("of").alias("name"), title.alias("value")))
        hub_links.append(made.select(F.col("hub").alias("source"), F.explode("sources").alias("target"), F.lit(link).alias("link_type")))
    new = hubs[0].unionByName(hubs[1]).unionByName(hubs[2])
    asked = direct.unionByName(against)
    for more in hub_links:
        asked = asked.unionByName(more)
    lists = ["id", *schema.LINK_TYPES]
    empty = [F.array().cast("array<string>").alias(t) for t in schema.LINK_TYPES]
    known = notes.select(*lists).unionByName(new.select("id", *empty))
    linked = graph.link_effects(known, asked.filter("source is not null and target is not null")).select("effect", "id", F.col("link_type").alias("name"), F.col("target").alias("value"))
    merged = row.filter("kind = 'merge_suggestion' and n >= 3 and said <> ''").select(F.explode("sources").alias("id"), "hub")
    moved = graph.moved_links(edges, merged.groupBy("id").agg(F.min("hub").alias("merged")))
    moved = moved.select(F.lit("edge").alias("effect"), F.col("source").alias("id"), F.col("edge_type").alias("name"), F.col("target").alias("value"))
    present = notes.select("id")

    def put(test: str, name: str, value: Column, ids: Column | None = None) -> DataFrame:
        rows = row.filter(test).select(F.lit("set").alias("effect"), (_first("sources") if ids is None else ids).alias("id"), F.lit(name).alias("name"), value.alias("value"))
        return rows.join(present, "id", "left_semi").select("effect", "id", "name", "value")

    sets = put("kind = 'staleness' and action = 'deprecate' and n > 0", "status", F.lit("deprecated"))
    for more in (
        put("kind = 'tag_refinement' and n > 0 and size(tags) > 0", "tags", F.array_join("tags", ",")), put("kind = 'compression' and n > 0 and said <> ''", "body", F.col("said")),
        put("kind = 'action_extraction' and n > 0 and said <> ''", "action", F.col("said")),
        put("kind = 'summarize' and n >= 3 and said <> ''", "status", F.lit("archived"), F.explode("sources")),
    ):
        sets = sets.unionByName(more)
    refs = direct.join(present.withColumnRenamed("id", "source"), "source", "left_semi").join(present.withColumnRenamed("id", "target"), "target", "left_semi").filter("source <> target")
    refs = refs.filter(F.col("link_type").isin(*schema.LINK_TYPES)).select(F.lit("body_ref").alias("effect"), F.col("source").alias("id"), F.lit("").alias("name"), F.col("target").alias("value"))
    signals = row.filter("kind = 'signal'").select(F.lit("signal").alias("effect"), F.col("action").alias("id"), F.array_join("tags", ",").alias("name"), F.col("said").alias("value"))
    out = new
    for more in (linked, moved, sets, refs, signals):
        out = out.unionByName(more)
    return out.distinct()


def batches(tasks: DataFrame, notes: DataFrame, size: int = 50, clustered: float = 0.6) -> DataFrame:
    """id, phase, cluster, batch: the notes that have tasks (id, task), put into batches of at most ``size``.

    The first ``clustered`` share of the notes goes by their first tag, the largest tags first; the others follow by id. Places
    come from global orders, so no tag and no rest is gathered. ``notes`` has id and tags.
    """
    ids = tasks.select("id").distinct().join(notes.select("id", F.get("tags", F.lit(0)).alias("tag")), "id", "left")
    sizes = ids.filter("tag is not null").groupBy("tag").agg(F.count("*").alias("k"))
    line = numbered(ids.join(sizes, "tag"), [], [F.desc("k"), F.col("tag"), F.col("id")], "g")
    quota = int(ids.count() * clustered)
    starts = line.groupBy("tag").agg(F.min("g").alias("start"))
    first = line.filter(F.col("g") <= quota).join(starts, "tag")
    first = first.select("id", F.lit("clustered").alias("phase"), F.col("tag").alias("cluster"), F.floor((F.col("g") - F.col("start")) / size).alias("part"), "k")
    rest = numbered(ids.join(first.select("id"), "id", "left_anti").select("id"), [], [F.col("id")], "g")
    rest = rest.select("id", F.lit("interleaved").alias("phase"), F.lit("").alias("cluster"), F.floor((F.col("g") - 1) / size).alias("part"), F.lit(0).cast("bigint").alias("k"))
    rows = first.unionByName(rest)
    keys = rows.select("phase", "cluster", "part", "k").distinct()
    named = numbered(keys, [], [F.col("phase"), F.desc("k"), F.col("cluster"), F.col("part")], "batch")
    return rows.join(named.drop("k"), ["phase", "cluster", "part"]).select("id", "phase", "cluster", F.col("batch").cast("bigint").alias("batch"))


def together(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    """The batches after each cluster (id, cluster_id) has moved to the batch that has most of it, the smallest of several."""
    held = placed.join(clusters.select("id", "cluster_id").distinct(), "id")
    counts = held.groupBy("cluster_id", "batch").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("batch"))).alias("b")).select("cluster_id", F.col("b.batch").alias("to"))
    moved = held.select("id", "cluster_id").join(best, "cluster_id").groupBy("id").agg(F.min("to").alias("to"))
    return placed.join(moved, "id", "left").select("id", F.coalesce("to", "batch").alias("batch"))


def batch_tasks(placed: DataFrame, tasks: DataFrame, most: int | None = None) -> DataFrame:
    """batch, n, tasks: size and sorted tasks of each batch, of the first ``most`` if given (clustered ones have the first numbers)."""
    kept = placed if most is None else placed.filter(F.col("batch") <= most)
    sizes = kept.groupBy("batch").agg(F.count("*").alias("n"))
    found = kept.join(tasks, "id").select("batch", "task").distinct().groupBy("batch").agg(F.array_sort(F.collect_list("task")).alias("tasks"))
    return sizes.join(found, "batch")


def run_summary(batch: DataFrame, final: DataFrame, n_batches: int, cost: float) -> DataFrame:
    """One row of the run log: what the batches proposed, what stayed after reconciliation, applied and deferred, mean confidence
    and agreement, the share filtered out, and the cost of a proposal."""
    given = batch.agg(F.count("*").alias("batch_proposals"))
    kept = final.agg(
        F.count("*").alias("proposals"), F.count(F.when(F.col("confidence") >= schema.AUTO_APPLY, 1)).alias("auto_applied"),
        F.count(F.when(F.col("confidence") < schema.AUTO_APPLY, 1)).alias("deferred"), F.avg("confidence").alias("avg_confidence"), F.avg("agreement").alias("avg_agreement"),
    )
    rate = F.when(F.col("batch_proposals") > 0, 1 - F.col("proposals") / F.col("batch_proposals")).otherwise(0.0)
    each = F.when(F.col("proposals") > 0, F.lit(cost) / F.col("proposals")).otherwise(0.0)
    return given.crossJoin(kept).select(F.lit(n_batches).alias("batches"), "*", rate.alias("filter_rate"), each.alias("cost_per_proposal"))


def rewrite_last(ledger: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """The ledger with new values in its last row by ``order``."""
    last = ledger.agg(F.max(order)).first()[0]
    is_last = F.col(order) == F.lit(last)
    return ledger.withColumns({c: F.when(is_last, v).otherwise(F.col(c)) for c, v in values.items()})


_FENCE = re.compile(schema.FENCE, re.DOTALL)
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)


def _json_in(text: str) -> str | None:
    fenced = _FENCE.search(text)
    inner = fenced.group(1) if fenced else text
    start = re.search(r"[{\[]", inner)
    if start is None:
        return None
    opening, depth = start.group(), 0
    closing = "}" if opening == "{" else "]"
    for mark in _MARKS.finditer(inner, start.start()):  # strings are marks of their own, so brackets in them do not count
        depth += (mark.group() == opening) - (mark.group() == closing)
        if depth == 0 and mark.group() == closing:
            return inner[start.start() : mark.end()]
    return None


def json_in(text: Column) -> Column:
    """The first balanced object or array of a text, of its first fenced block if it has one; null if there is none."""

    @F.pandas_udf("string")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(_json_in, na_action="ignore").astype(object)

    return found(text)


def said(value: Column, *names: str) -> Column:
    """A value that is JSON text of a string or of an object: the string, or the first of the object's fields that it has."""
    plain = F.when(value.rlike(r'^\s*"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0])
    return F.coalesce(plain, *[F.get_json_object(value, f"$.{n}") for n in names], F.when(~value.rlike(r'^\s*[{\["]'), value))
