"""The cleaned view of the notes and the filters, counts and joins over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.functions.scoring import access_bonus, age_days, recency, salience, specificity
from notegraph.operators import products
from notegraph.operators.order import numbered
from notegraph.scratch import materialize
from notegraph.sources.tables import distinct_notes, table, trimmed

SCALARS = ("type", "status", "title", "weight", "origin", "created_at", "body", "source_issue", "size", "last_accessed", "access_count")
LISTS = ("tags", *schema.LINK_TYPES, "acceptance")


def note_view(notes: DataFrame, *columns: str) -> DataFrame:
    """id and the given columns, one row per id: lists trimmed and without blanks, body and counts not null, parent null if blank."""
    out = []
    for name in columns:
        value = F.col(name)
        if name in LISTS:
            value = tx.clean_list(value)
        elif name == "body":
            value = F.coalesce(value, F.lit(""))
        elif name == "access_count":
            value = F.coalesce(value, F.lit(0))
        elif name in ("parent", "source_issue"):
            value = F.nullif(trimmed(value), F.lit(""))
        out.append(value.alias(name))
    return distinct_notes(notes, *columns).select("id", *out)


def view(spark: SparkSession, folder: str, *columns: str, where: str | None = None) -> DataFrame:
    """The view of the notes table. ``where`` filters the stored rows, so it reaches the scan and shrinks the shuffle; as
    repeated rows of an id are identical it may stand before their reduction."""
    notes = table(spark, folder, "notes")
    return note_view(notes if where is None else notes.filter(where), *columns)


def search_text() -> Column:
    """Title, body, and provider and id of each external reference, as one text."""
    refs = F.transform("external_refs", lambda r: F.concat(F.lit(" "), F.coalesce(r["provider"], F.lit("")), F.lit(" "), F.coalesce(r["id"], F.lit(""))))
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")), F.coalesce(F.array_join(refs, ""), F.lit("")))


def list_notes(notes: DataFrame, kind: str | None = None, status: str | None = None, tag: str | None = None, parent: str | None = None) -> DataFrame:
    """The notes that have all given values; a tag compares with case."""
    for name, value in (("type", kind), ("status", status), ("parent", parent)):
        if value is not None:
            notes = notes.filter(F.col(name) == value)
    return notes if tag is None else notes.filter(F.array_contains("tags", tag))


def not_seen_for(days: int, as_of: str) -> Column:
    """Never accessed, or not within ``days`` days of the clock."""
    return F.col("last_accessed").isNull() | (F.col("last_accessed").cast("timestamp") <= F.expr(f"timestamp '{as_of}' - interval {days} days"))


def decay_risk(notes: DataFrame, as_of: str, cfg: schema.Scoring = schema.SCORING) -> DataFrame:
    """Active heavy notes, last seen 30 to 90 days ago, whose score is barely above the threshold."""
    days = age_days(F.col("last_accessed"), as_of)
    factor = recency(days)
    score = (F.col("weight") + access_bonus(F.col("access_count"), cfg) + salience(F.col("origin"), F.col("type"), cfg)) * factor
    heavy = notes.filter("status = 'active' and weight >= 0.7 and (origin = 'failure' or type = 'explore') and last_accessed is not null")
    found = heavy.filter((days >= 30) & (days < 90)).select("id", "weight", factor.alias("recency_factor"), score.alias("score"), (score - cfg.min_threshold).alias("score_gap"))
    return found.filter("score_gap >= 0 and score_gap <= 0.1")


def tag_counts(notes: DataFrame) -> DataFrame:
    """tag, n: occurrences, repeats within a note included."""
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def inferred_tags(notes: DataFrame, most: int = 5) -> DataFrame:
    """id, tags: the first ``most`` keywords of the title that are tags of any note; notes without any have no row."""
    known = tag_counts(notes).select(F.col("tag").alias("word"))
    words = notes.select("id", F.posexplode(tx.keywords(F.col("title"))).alias("pos", "word")).join(known, "word", "left_semi")
    found = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("found"))
    return found.select("id", F.slice("found.word", 1, most).alias("tags"))


def tag_audit(notes: DataFrame, overload: int = 15) -> DataFrame:
    """tag, n, specificity, status: orphaned if all carriers are done with, else overloaded, unique or ok."""
    rows = notes.select("id", "status", F.explode("tags").alias("tag"))
    counted = rows.groupBy("tag").agg(F.count("*").alias("n"), F.bool_and(F.col("status").isin("deprecated", "archived")).alias("gone"))
    kind = F.when(F.col("gone"), "orphaned").when(F.col("n") > overload, "overloaded").when(F.col("n") == 1, "unique").otherwise("ok")
    return counted.select("tag", "n", specificity(F.col("n")).alias("specificity"), kind.alias("status"))


def companions(notes: DataFrame, k: int = 3) -> DataFrame:
    """tag, other, n, rank: the k tags most often on the same note. Pairs are formed within a note, never within a tag."""
    sets = notes.select(F.array_distinct("tags").alias("tags"))
    pairs = sets.select(F.explode("tags").alias("tag"), "tags").select("tag", F.explode("tags").alias("other")).filter("tag <> other")
    counts = pairs.groupBy("tag", "other").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "other"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def shared_term_pairs(terms: DataFrame, at_least: int = 3) -> DataFrame:
    """a < b, n_shared: every pair of notes with at least ``at_least`` terms in common, from (id, term).

    A pair that shares k terms shares one among all but the k - 1 most frequent terms of each note, so only those are
    joined; terms that very many notes have stand last and hardly ever meet. Nothing is left out.
    """
    rows = terms.filter("id is not null and term is not null").distinct()
    sized = rows.join(rows.groupBy("term").agg(F.count("*").alias("df")), "term")
    sets = sized.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms")).filter(F.size("terms") >= at_least)
    sets = sets.select("id", F.col("terms.term").alias("terms"))
    keys = sets.select("id", F.explode(F.slice("terms", F.lit(1), F.size("terms") - (at_least - 1))).alias("term"), "terms")
    a = keys.select(F.col("id").alias("a"), "term", F.col("terms").alias("terms_a"))
    b = keys.select(F.col("id").alias("b"), "term", F.col("terms").alias("terms_b"))
    shared = F.array_intersect("terms_a", "terms_b")
    met = a.join(b, "term").filter(F.col("a") < F.col("b"))
    # each pair is kept where its first common key stands, so it comes out once
    once = met.filter(F.col("term") == F.array_min(F.array_intersect(
        F.slice("terms_a", F.lit(1), F.size("terms_a") - (at_least - 1)), F.slice("terms_b", F.lit(1), F.size("terms_b") - (at_least - 1)))))
    return once.select("a", "b", F.size(shared).alias("n_shared")).filter(F.col("n_shared") >= at_least)


def term_sets(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, terms: the tags of notes (id, status, tags) that are not deprecated and the concepts that a source of any status refers to."""
    tags = notes.filter(F.coalesce("status", F.lit("")) != "deprecated").select("id", F.explode("tags").alias("term"))
    concepts = edges.filter("edge_type = 'concept_ref'").select(F.col("source").alias("id"), F.col("target").alias("term"))
    return tags.unionByName(concepts).filter("id is not null and term is not null").groupBy("id").agg(F.collect_set("term").alias("terms"))


#: Less than any number of common terms makes up for.
_LINKED = -1e9


def _candidates(notes: DataFrame, edges: DataFrame, at_least: int, **how: int | bool) -> DataFrame:
    """query_id, id, score: pairs of notes with so many terms in common and no edge from the smaller id to the larger.

    A term counts 1; a linked pair also shares a term of its own that takes it below any number."""
    sets = materialize(term_sets(notes, edges).filter(F.size("terms") >= at_least), "term-sets")
    linked = edges.filter("source < target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    both = linked.select(F.col("a").alias("id"), F.col("b").alias("other")).union(linked.select(F.col("b").alias("id"), F.col("a").alias("other")))
    barred = both.groupBy("id").agg(F.collect_list(F.concat(F.lit("x"), "other")).alias("barred"))
    words = F.transform("terms", lambda t: F.concat(F.lit("t"), t))
    none = F.array().cast("array<string>")
    rows = sets.join(barred, "id", "left").select(
        "id", F.concat(words, F.coalesce("barred", none)).alias("terms"),
        F.concat(F.transform(words, lambda _: F.lit(1.0)), F.transform(F.coalesce("barred", none), lambda _: F.lit(_LINKED))).alias("weights"),
    )
    asked = sets.select(F.col("id").alias("query_id"), F.explode(F.concat(words, F.array(F.concat(F.lit("x"), "id")))).alias("term"), F.lit(1.0).alias("weight"))
    return products.matches(materialize(rows, "terms"), asked, least=float(at_least), **how)


def link_candidates(notes: DataFrame, edges: DataFrame, at_least: int = 3) -> DataFrame:
    """a < b, n_shared: pairs that share terms (``term_sets``) and have no edge from a to b yet, from notes (id, status, tags) and
    live edges."""
    found = _candidates(notes, edges, at_least, after=True)
    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").cast("int").alias("n_shared"))


def in_link_candidates(notes: DataFrame, edges: DataFrame, at_least: int = 3) -> DataFrame:
    """id of the notes in a pair of ``link_candidates``; one partner of each is looked for, the pairs are not listed."""
    return _candidates(notes, edges, at_least, k=1, others=True).select(F.col("query_id").alias("id")).distinct()


def without_shared_terms(pairs: DataFrame, notes: DataFrame, edges: DataFrame, at_least: int = 3) -> DataFrame:
    """The pairs (a, b, other columns) that do not have so many terms in common."""
    sets = term_sets(notes, edges)
    of_a, of_b = (sets.select(F.col("id").alias(x), F.col("terms").alias(f"_terms_{x}")) for x in ("a", "b"))
    both = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.filter(F.coalesce(F.size(F.array_intersect("_terms_a", "_terms_b")), F.lit(0)) < at_least).select(*pairs.columns)


def flow(notes: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """days, created, seen: notes created and last accessed within each of the windows before the clock."""
    made, seen = age_days(F.col("created_at"), as_of), age_days(F.col("last_accessed"), as_of)
    spread = notes.select(made.alias("made"), seen.alias("seen"), F.explode(F.array(*map(F.lit, windows))).alias("days"))
    return spread.groupBy("days").agg(
        F.count(F.when(F.col("made") < F.col("days"), 1)).alias("created"), F.count(F.when(F.col("seen") < F.col("days"), 1)).alias("seen")
    )


def progress(notes: DataFrame) -> DataFrame:
    """parent, children, done, criteria, met: roll-up of the children of each note that has any."""
    rows = notes.filter("parent is not null").select(
        "parent", F.col("status").isin("completed", "archived").alias("done"), F.size("acceptance").alias("criteria"),
        F.size(F.filter(F.coalesce("acceptance_met", F.array().cast("array<boolean>")), lambda x: x)).alias("met"),
    )
    return rows.groupBy("parent").agg(
        F.count("*").alias("children"), F.count(F.when(F.col("done"), 1)).alias("done"), F.sum("criteria").alias("criteria"), F.sum("met").alias("met")
    )


def field_changes(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """id, field, old, new for each compared column that differs between two states of the notes present in both."""
    pair = old.alias("o").join(new.alias("n"), "id")
    changes = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in columns])
    return pair.select("id", F.inline(changes)).filter("not (old <=> new)")


def net_flow(notes: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """days, created, closed, net of each window before the clock; only a status change into done or deprecated closes a note.

    ``notes`` has created_at, status and status_changed_at.
    """
    made, left = age_days(F.col("created_at"), as_of), age_days(F.col("status_changed_at"), as_of)
    shut = F.when(F.col("status").isin("deprecated", "archived", "completed"), left)
    spread = notes.select(made.alias("made"), shut.alias("shut"), F.explode(F.array(*map(F.lit, windows))).alias("days"))
    counts = spread.groupBy("days").agg(
        F.count(F.when(F.col("made") < F.col("days"), 1)).alias("created"), F.count(F.when(F.col("shut") < F.col("days"), 1)).alias("closed")
    )
    return counts.withColumn("net", F.col("created") - F.col("closed"))


def bloated(notes: DataFrame, as_of: str, least: int = 20, created: int = 15, days: int = 30) -> DataFrame:
    """One row: the size of the collection, what was created and closed lately, and whether it only grows."""
    recent = net_flow(notes, as_of, (days,)).select("created", "closed")
    n = notes.agg(F.count("*").alias("n"))
    return n.crossJoin(recent).select("n", "created", "closed", ((F.col("n") >= least) & (F.col("created") >= created) & (F.col("closed") == 0)).alias("bloat"))


def missing_hubs(notes: DataFrame, least: int = 3) -> DataFrame:
    """tag, n, hub_id: tags on at least ``least`` notes in force that no constellation note carries, with the id of a hub to add."""
    rows = notes.filter("status <> 'deprecated'").select("id", "type", F.explode(F.array_distinct("tags")).alias("tag"))
    tags = rows.groupBy("tag").agg(F.count("*").alias("n"), F.bool_or(F.col("type") == "constellation").alias("held"))
    return tags.filter((F.col("n") >= least) & ~F.coalesce("held", F.lit(False))).select("tag", "n", F.concat(F.lit("hub-"), "tag").alias("hub_id"))


def hub_links(notes: DataFrame, hubs: DataFrame) -> DataFrame:
    """source, target, edge_type: both sides of the links of each new hub (tag, hub_id) to the notes in force that carry its tag."""
    rows = notes.filter("status <> 'deprecated'").select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(hubs.select("tag", "hub_id"), "tag")
    sides = F.array(F.struct(F.col("hub_id").alias("source"), F.col("id").alias("target")), F.struct(F.col("id").alias("source"), F.col("hub_id").alias("target")))
    return rows.select(F.inline(sides)).withColumn("edge_type", F.lit("relates_to"))


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The key, its most frequent value (the smallest of equally frequent ones) and how often it has it; nulls do not count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    line = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(line)).filter("_r = 1").drop("_r")


def opposed_classes(notes: DataFrame) -> DataFrame:
    """tag, mask_a < mask_b, n_pairs: how many pairs of notes with the tag differ in the words against something that their bodies
    hold. A mask has a bit for each such word, so a tag has few masks however many notes carry it."""
    body = F.lower(F.coalesce("body", F.lit("")))
    mask = F.lit(0)
    for i, word in enumerate(schema.NEGATORS):
        mask = mask + F.when(F.contains(body, F.lit(word)), 1 << i).otherwise(0)
    rows = notes.select(mask.alias("mask"), F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag", "mask").agg(F.count("*").alias("k"))
    a = rows.select("tag", F.col("mask").alias("mask_a"), F.col("k").alias("k_a"))
    b = rows.select("tag", F.col("mask").alias("mask_b"), F.col("k").alias("k_b"))
    return a.join(b, "tag").filter("mask_a < mask_b").select("tag", "mask_a", "mask_b", (F.col("k_a") * F.col("k_b")).alias("n_pairs"))


def listed(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The key, each of its members once, and ``place`` in the key's list; a key with very many members stays many rows."""
    return numbered(rows.select(key, member).distinct(), [key], [F.col(member)], "place")


def summary_clusters(notes: DataFrame, least: int) -> DataFrame:
    """id, a, b: completed notes that no summary builds on, each in the largest pair of tags on at least ``least`` of them.

    Pairs are formed within a note, and each note keeps its largest (of equals the smallest pair); clusters that keep fewer
    than ``least`` notes are none.
    """
    summed = notes.filter((F.col("type") == "context") & F.contains(F.coalesce("title", F.lit("")), F.lit("Summary"))).select(F.explode("builds_on").alias("id")).distinct()
    open_ = notes.filter("status = 'completed'").join(summed, "id", "left_anti").select("id", F.array_distinct("tags").alias("tags"))
    pairs = open_.select("id", F.explode("tags").alias("a"), "tags").select("id", "a", F.explode("tags").alias("b")).filter("a < b")
    sizes = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "a", "b"))
    kept = pairs.join(sizes, ["a", "b"]).withColumn("_r", best).filter("_r = 1").select("id", "a", "b")
    large = kept.groupBy("a", "b").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    return kept.join(large, ["a", "b"], "left_semi").select("id", "a", "b")


def successors(notes: DataFrame, most: int = 3) -> DataFrame:
    """id, successor, n_shared, rank, next_id: for each deprecated note the heaviest live notes that share a tag with it.

    The ``most`` + 1 heaviest of all that share a tag are among the ``most`` + 1 heaviest of one of the tags, so a tag on very
    many notes brings no more rows, and none is lost. Notes of equal weight are in order of their ids.
    """
    tagged = notes.select("id", "status", "weight", F.array_distinct("tags").alias("tags"))
    rows = tagged.select("id", "status", "weight", F.explode("tags").alias("tag"))
    heavy = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc_nulls_last("weight"), "id"))
    best = rows.filter(F.col("status").isin(*schema.LIVE)).withColumn("_r", heavy).filter(F.col("_r") <= most + 1).select("tag", F.col("id").alias("successor"), "weight")
    met = rows.filter("status = 'deprecated'").select("id", "tag").join(best, "tag").select("id", "successor", "weight").distinct()
    line = Window.partitionBy("id").orderBy(F.desc_nulls_last("weight"), "successor")
    placed = met.withColumn("rank", F.row_number().over(line)).withColumn("next_id", F.lead("successor").over(line)).filter(F.col("rank") <= most)
    full = placed.join(tagged.select("id", "tags"), "id").join(tagged.select(F.col("id").alias("successor"), F.col("tags").alias("_tags")), "successor")
    return full.select("id", "successor", F.size(F.array_intersect("tags", "_tags")).cast("bigint").alias("n_shared"), "rank", "next_id")
