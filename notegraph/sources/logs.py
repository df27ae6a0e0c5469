"""JSON-lines logs and exports: lenient reads, appends, filtered export and duplicate-free import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.functions.text import tag_problem
from notegraph.operators.order import numbered

# The fields of the logs, of exports and of imported issues.
LOGS = {
    "access": "mote_id string, accessed_at timestamp, agent_id string, primed boolean",
    "edges": "source string, target string, edge_type string, deleted boolean",
    "queries": "timestamp timestamp, query string, corpus string, results_count int, top_chunk_id string, top_score double",
    "feedback": "timestamp timestamp, chunk_id string, corpus string, query_terms string, useful boolean",
    "proposals": "type string, action string, source_notes array<string>, target_notes array<string>, link_type string, rationale string, severity string, tags array<string>, confidence double, agreement double, lens_source string, cross_lens_agreement array<string>",
    "applied": "timestamp timestamp, proposal_type string, action string, source_notes array<string>, target_notes array<string>, link_type string, tags array<string>, confidence double, pre_scores map<string, double>, post_scores map<string, double>, score_delta double, persisted boolean, checked_at timestamp",
    "issues": "id string, title string, description string, status string, priority int, issue_type string, created_at timestamp, labels array<string>",
    "audit": "operation string, mote_id string, agent_id string, timestamp timestamp, fields_set array<string>",
}
EXPORTED = (
    "id", "type", "status", "title", "tags", "weight", "origin", "created_at", "body", "depends_on", "blocks", "relates_to", "builds_on",
    "contradicts", "supersedes", "caused_by", "informed_by", "source_issue", "parent", "acceptance", "acceptance_met", "size", "external_refs",
)
# End of fixed values.


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a log that are JSON objects of the schema; others are left out."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").filter("_bad is null").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_notes(notes: DataFrame, path: str, kind: str | None = None, status: str | None = None, tag: str | None = None) -> None:
    """Write the exported columns of the matching notes as JSON lines."""
    for name, value in (("type", kind), ("status", status)):
        if value is not None:
            notes = notes.filter(F.col(name) == value)
    if tag is not None:
        notes = notes.filter(F.array_contains("tags", tag))
    notes.select(*[c for c in EXPORTED if c in notes.columns]).write.json(path)


def content_hash() -> Column:
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in ("type", "title", "body")]), 256)


def new_notes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Of the incoming notes those whose type, title and body no existing note has, each content once, the smallest id."""
    held = existing.select(content_hash().alias("hash")).distinct()
    fresh = incoming.withColumn("hash", content_hash()).join(held, "hash", "left_anti")
    first = fresh.groupBy("hash").agg(F.min("id").alias("id"))
    return fresh.join(first, ["hash", "id"]).dropDuplicates(["hash", "id"]).drop("hash")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of JSON lines as notes to create: id (of the issue), type task, title, body, tags, priority; without a title none.

    Labels become tags as far as they are valid ones; repeated issues are one.
    """
    rows = read_log(spark, path, LOGS["issues"]).filter("id is not null and trim(coalesce(title, '')) <> ''").dropDuplicates(["id"])
    labels = F.array_distinct(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    tags = F.filter(labels, lambda x: tag_problem(x).isNull())
    return rows.select(F.col("id").alias("source_issue"), F.lit("task").alias("type"), "title", F.coalesce("description", F.lit("")).alias("body"), tags.alias("tags"), "priority", "created_at")


def merge_patterns(held: DataFrame, seen: DataFrame) -> DataFrame:
    """pattern_id, description, strength, ids of a journal after further observations: strengths add up, ids are united, the first
    description stays (held before seen, then the smallest)."""
    both = held.withColumn("_o", F.lit(0)).unionByName(seen.withColumn("_o", F.lit(1)))
    sums = both.groupBy("pattern_id").agg(F.sum("strength").alias("strength"), F.min(F.struct("_o", "description")).alias("d"))
    ids = both.select("pattern_id", F.explode_outer("ids").alias("id")).distinct().groupBy("pattern_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return sums.join(ids, "pattern_id").select("pattern_id", F.col("d.description").alias("description"), "strength", "ids")


def pruned(entries: DataFrame, budget_bytes: int, least: int) -> DataFrame:
    """The newest entries (pos, text) whose sizes add up to at most the budget, and in any case the ``least`` newest."""
    line = numbered(entries, [], [F.desc("pos")], "_n")
    # sizes of ranges of places, then within one range
    span = line.withColumn("_size", F.octet_length("text")).withColumn("_range", F.floor(F.col("_n") / 4096))
    sums = span.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("_size").over(Window.partitionBy("_range").orderBy("_n"))
    kept = span.join(before.select("_range", "_before"), "_range").withColumn("_upto", upto + F.col("_before"))
    return kept.filter((F.col("_upto") <= budget_bytes) | (F.col("_n") <= least)).select(*entries.columns)
