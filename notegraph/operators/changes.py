"""Changes of the notes as transformations from one state to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators.graph import incident, links_in, reverse_of, tombstones


def merge_scopes(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Local notes and those shared notes whose id is not local; shared context, archived and deprecated notes do not count."""
    allowed = shared.filter("type <> 'context' and status not in ('archived', 'deprecated')")
    return local.unionByName(allowed.join(local.select("id"), "id", "left_anti"), allowMissingColumns=True)


def apply_patch(notes: DataFrame, patch: DataFrame, as_of: str) -> DataFrame:
    """Notes with the non-null values of the patch (id, some columns); a new status stamps ``status_changed_at``."""
    names = [c for c in patch.columns if c != "id"]
    once = patch.groupBy("id").agg(*[F.max(c).alias(f"_{c}") for c in names])
    joined = notes.join(once, "id", "left")
    values = {c: F.coalesce(f"_{c}", c) for c in names}
    if "status" in names:
        stamp = F.lit(as_of).cast("timestamp_ntz")
        before = F.col("status_changed_at") if "status_changed_at" in notes.columns else F.lit(None).cast("timestamp_ntz")
        values["status_changed_at"] = F.when(F.col("_status").isNotNull() & ~F.col("_status").eqNullSafe(F.col("status")), stamp).otherwise(before)
    return joined.withColumns(values).drop(*[f"_{c}" for c in names])


def adjusted_weight(feedback: Column) -> Column:
    """Weight after ``useful`` (+0.05) or ``irrelevant`` (-0.05) feedback, kept between 0.1 and 1."""
    step = F.when(feedback == "useful", 0.05).when(feedback == "irrelevant", -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("weight") + step))


def toggled(item: Column) -> Column:
    """``acceptance_met`` with the criterion ``item`` (from 1) flipped, as long as the list of criteria."""
    met = F.coalesce("acceptance_met", F.array().cast("array<boolean>"))
    at = F.sequence(F.lit(1), F.greatest(F.size("acceptance"), F.lit(1)))
    flags = F.transform(at, lambda i: F.coalesce(F.try_element_at(met, i), F.lit(False)) != (i == item))
    return F.slice(flags, F.lit(1), F.size("acceptance"))


def unlink(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """id, link_type, target of the links left after the requests (source, target, link_type): the link and its other side go."""
    inverse = reverse_of(F.col("link_type"))
    gone = requests.select(F.col("source").alias("id"), "link_type", "target").unionByName(
        requests.select(F.col("target").alias("id"), inverse.alias("link_type"), F.col("source").alias("target"))
    )
    return links_in(notes).join(gone.filter("link_type is not null").distinct(), ["id", "link_type", "target"], "left_anti").select("id", "link_type", "target")


def delete(notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes that stay, and their links (id, link_type, target) without those to the deleted ids (id)."""
    gone = ids.select("id").distinct()
    stay = notes.join(gone, "id", "left_anti")
    return stay, links_in(stay).join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("id", "link_type", "target")


def rewrite_links(notes: DataFrame, moved: DataFrame) -> DataFrame:
    """id, link_type, target with every id replaced that ``moved`` (old, new) has; links to itself vanish, equal ones are one."""
    links = links_in(notes).select("id", "link_type", "target")
    by_target = links.join(moved.select(F.col("old").alias("target"), F.col("new").alias("t")), "target", "left")
    both = by_target.join(moved.select(F.col("old").alias("id"), F.col("new").alias("s")), "id", "left")
    out = both.select(F.coalesce("s", "id").alias("id"), "link_type", F.coalesce("t", "target").alias("target"))
    return out.filter("id <> target").distinct()


def create(incoming: DataFrame) -> DataFrame:
    """The incoming notes with defaults, ``problem`` (why a note is rejected, null if it is accepted) and ``n_warnings``.

    Checked in order: type, blank title, tags, weight, origin, size, blocked content of the body. An absent weight is 0.5, an
    absent origin normal, the status active.
    """
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: tx.tag_problem(t).isNotNull())
    problem = (
        F.when(~F.coalesce(F.col("type").isin(*schema.TYPES), F.lit(False)), "type")
        .when(F.btrim(F.coalesce("title", F.lit("")), F.lit(" \t\r\n")) == "", "title")
        .when(F.size(tags) > 0, "tags")
        .when(~F.coalesce(F.col("weight").between(0.0, 1.0), F.lit(True)), "weight")
        .when(~F.coalesce(F.col("origin").isin("", *schema.ORIGINS), F.lit(True)), "origin")
        .when(~F.coalesce(F.col("size").isin("", *schema.SIZES), F.lit(True)), "size")
        .when(F.size(tx.secrets(F.col("body"), schema.BLOCKING_PATTERNS)) > 0, "blocked content")
    )
    return incoming.withColumns({
        "problem": problem, "n_warnings": F.size(tx.secrets(F.col("body"), schema.WARNING_PATTERNS)),
        "weight": F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(0.5)), "origin": F.coalesce(F.nullif("origin", F.lit("")), F.lit("normal")),
        "status": F.lit("active"),
    })


def snapshot(notes: DataFrame, as_of: str) -> DataFrame:
    """id, snapshot_at, status, title, weight, tags, acceptance, links and hash of the body; lists as one text each."""
    link = [F.when(F.size(t) > 0, F.concat(F.lit(t + ": "), F.array_join(t, ", "))) for t in schema.LINK_TYPES]
    return notes.select(
        "id", F.lit(as_of).alias("snapshot_at"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("title", F.lit("")).alias("title"), "weight",
        F.array_join("tags", ", ").alias("tags"), F.array_join("acceptance", "; ").alias("acceptance"),
        *[F.array_join(t, ", ").alias(f"links.{t}") for t in schema.LINK_TYPES], F.array_join(F.array_compact(F.array(*link)), " | ").alias("links"),
        F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash"),
    )


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, field, old, new between two snapshots of the notes in both; of bodies only that they differ."""
    names = ["status", "title", "weight", "tags", *[f"links.{t}" for t in schema.LINK_TYPES], "acceptance"]
    pair = old.alias("o").join(new.alias("n"), "id")
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"o.`{c}`").cast("string").alias("old"), F.col(f"n.`{c}`").cast("string").alias("new")) for c in names]
    body = F.col("o.body_hash") != F.col("n.body_hash")
    parts.append(F.struct(F.lit("body").alias("field"), F.lit("(changed)").alias("old"), F.when(~body, "(changed)").otherwise("(changed) ").alias("new")))
    return pair.select("id", F.inline(F.array(*parts))).filter("not (old <=> new)").withColumn("new", F.rtrim("new"))


def delete_effects(notes: DataFrame, log: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """effect, id, link_type, target of a deletion: ``trash`` with its time, ``tombstone`` for each live edge, ``unlink`` for each
    link of a remaining note to a deleted one."""
    gone = ids.select("id").distinct().join(notes.select("id"), "id", "left_semi")
    trash = gone.select(F.lit("trash").alias("effect"), "id", F.lit("").alias("link_type"), F.lit(as_of).alias("target"))
    lines = tombstones(log, incident(log.select("source", "target", "edge_type"), gone))
    lines = lines.select(F.lit("tombstone").alias("effect"), F.col("source").alias("id"), F.col("edge_type").alias("link_type"), "target")
    stay = links_in(notes).join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_semi")
    return trash.unionByName(lines).unionByName(stay.select(F.lit("unlink").alias("effect"), "id", "link_type", "target").distinct())


def restore(trash: DataFrame, live: DataFrame, ids: DataFrame) -> DataFrame:
    """id, outcome of asking for notes back: ``restored``, ``exists`` (the id is taken by a live note) or ``not in trash``."""
    asked = ids.select("id").distinct().join(live.select("id", F.lit(True).alias("taken")), "id", "left")
    asked = asked.join(trash.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    return asked.select("id", F.when(F.col("there").isNull(), "not in trash").when(F.col("taken"), "exists").otherwise("restored").alias("outcome"))


def trash_state(trash: DataFrame, as_of: str, retention_days: int = 30, everything: bool = False) -> DataFrame:
    """id, expired, days_left (up to the next whole day) of deleted notes (id, deleted_at); without a time only ``everything`` expires."""
    now, at = (F.unix_micros(F.lit(as_of).cast("timestamp")), F.unix_micros(F.col("deleted_at").cast("timestamp")))
    left = at + F.lit(retention_days * 86_400_000_000) - now
    expired = F.lit(True) if everything else F.coalesce(left <= 0, F.lit(False))
    return trash.select("id", expired.alias("expired"), F.ceil(left / 86_400_000_000).cast("bigint").alias("days_left"))


def rewrite_notes(notes: DataFrame, moved: DataFrame) -> DataFrame:
    """id, parent, body after every id that ``moved`` (old, new) has is replaced, also in ``[[id]]`` of bodies."""
    renamed = notes.join(moved.select(F.col("old").alias("parent"), F.col("new").alias("_p")), "parent", "left")
    found = notes.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(schema.WIKI_LINK), F.lit(1)))).alias("old"))
    names = found.join(moved, "old").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
    # a piece starts with the name of a link: up to its brackets it is replaced
    pieces = F.split("body", r"\[\[(?=[a-zA-Z0-9._-]+\]\])")

    def piece(text: Column, i: Column) -> Column:
        name = F.substring_index(text, "]]", 1)
        new = F.coalesce(F.try_element_at("names", name), name)
        return F.when(i == 0, text).otherwise(F.concat(F.lit("[["), new, F.substring(text, F.length(name) + 1, F.length(text))))

    body = F.when(F.col("names").isNull(), F.col("body")).otherwise(F.array_join(F.transform(pieces, piece), ""))
    return renamed.join(names, "id", "left").select("id", F.coalesce("_p", "parent").alias("parent"), body.alias("body"))


def forwarded(notes: DataFrame, moved: DataFrame) -> DataFrame:
    """id, forwarded_to, status of a move to other ids: moved notes under the new id, and a tombstone under the old one."""
    pair = notes.select("id", "status").join(moved.select(F.col("old").alias("id"), "new"), "id", "left")
    kept = pair.select(F.coalesce("new", "id").alias("id"), F.lit(None).cast("string").alias("forwarded_to"), "status")
    return kept.unionByName(pair.filter("new is not null").select("id", F.col("new").alias("forwarded_to"), F.lit("").alias("status")))
