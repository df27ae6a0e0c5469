"""Queries of files: notes as markdown, logs, proposals, exports and imports, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.operators import review
from notegraph.operators.notes import view
from notegraph.plans.retrieval import SQL as SECTIONS
from notegraph.plans.sqlparts import NOTES
from notegraph.scratch import new_path
from notegraph.sources import corpus, logs, notes_md
from notegraph.sources.tables import table

STAMP = "yyyy-MM-dd HH:mm:ss"


def s01_parsed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes written as markdown with front matter and parsed again; every tenth has front matter that is no mapping."""
    notes = view(spark, folder, "type", "title", "tags", "weight", "acceptance", "acceptance_met", "external_refs", "body")
    lines = [
        F.concat(F.lit("id: "), "id"), F.concat(F.lit("type: "), F.coalesce("type", F.lit("~"))), F.concat(F.lit("title: "), F.to_json(F.array("title"))), F.concat(F.lit("tags: "), F.to_json("tags")),
        F.concat(F.lit("weight: "), F.coalesce(F.col("weight").cast("string"), F.lit("null"))), F.concat(F.lit("acceptance: "), F.to_json("acceptance")),
        F.concat(F.lit("acceptance_met: "), F.to_json(F.coalesce("acceptance_met", F.array().cast("array<boolean>")))),
        F.concat(F.lit("external_refs: "), F.to_json(F.coalesce("external_refs", F.array().cast("array<struct<provider:string,id:string,url:string>>")))),
    ]
    front = F.when(F.col("id").endswith("a"), F.lit("- just\n- a list")).otherwise(F.concat_ws("\n", *lines))
    texts = notes.select(F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "body").alias("value"), F.concat(F.lit("/p/alpha/nodes/"), "id", F.lit(".md")).alias("file_path"))
    found = notes_md.parse_notes(texts)
    return found.select(
        "id", "type", F.array_join("tags", ",").alias("tags"), F.round("weight", 6).alias("weight"), F.array_join("acceptance", ";").alias("acceptance"),
        F.size(F.filter("acceptance_met", lambda x: x)).cast("bigint").alias("n_met"), F.size("external_refs").cast("bigint").alias("n_refs"), F.md5("body").alias("hash"), "origin_scope",
    )


def s18_access_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The access log written as JSON lines among broken ones, and read back leniently, by note."""
    path = new_path(spark, "log")
    log = table(spark, folder, "access_log").select("mote_id", F.col("accessed_at").cast("timestamp").alias("accessed_at"), "agent_id", "primed")
    logs.append_log(log, path)
    log.filter("primed").select(F.lit('{"mote_id": "broken", ').alias("value")).write.mode("append").text(path)
    held = logs.read_log(spark, path, logs.LOGS["access"]).filter("mote_id is not null and accessed_at is not null")
    return held.groupBy("mote_id").agg(F.count("*").alias("n"), F.date_format(F.max("accessed_at"), STAMP).alias("last"), F.count(F.when(F.col("primed"), 1)).alias("primed"))


def s20_proposal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals written as JSON lines and read back: links that the notes ask for, those without a source or rationale left out."""
    path = new_path(spark, "proposals")
    notes = view(spark, folder, "title", "weight", "tags", "informed_by")
    rows = notes.select(
        F.lit("link_suggestion").alias("type"), F.lit("add").alias("action"), F.when(F.size("tags") > 0, F.array("id")).otherwise(F.array().cast("array<string>")).alias("source_notes"),
        F.col("informed_by").alias("target_notes"), F.col("title").alias("rationale"), "tags", F.col("weight").alias("confidence"),
    )
    logs.append_log(rows, path)
    read = logs.read_log(spark, path, logs.LOGS["proposals"]).withColumnsRenamed({"type": "kind", "source_notes": "sources", "target_notes": "targets"})
    return review.valid_proposals(read).select(F.col("sources")[0].alias("id"), "severity", F.size("targets").cast("bigint").alias("n_targets"), F.round("confidence", 6).alias("confidence"))


def s24_export(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with a tag exported as JSON lines and read back."""
    path = new_path(spark, "export")
    logs.export_notes(view(spark, folder, "type", "status", "title", "tags", "weight", "body", *schema.LINK_TYPES), path, kind="task", tag="backend")
    back = spark.read.schema("id string, type string, title string, tags array<string>, body string").json(path)
    return back.select("id", "title", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("hash"))


def s25_import(spark: SparkSession, folder: str) -> DataFrame:
    """Notes exported and imported into a collection that has the completed ones: those whose content is new, each content once."""
    path = new_path(spark, "export")
    notes = view(spark, folder, "type", "status", "title", "body")
    logs.export_notes(notes, path)
    incoming = spark.read.schema("id string, type string, status string, title string, body string").json(path)
    return logs.new_notes(incoming, notes.filter("status = 'completed'")).select("id", "type")


def s12_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of one corpus for each language: chunks and manifest of files, and the anchor note of each corpus."""
    docs = table(spark, folder, "documents").select(
        F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("corpus"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text")
    )
    chunks, files = corpus.ingest(docs.withColumn("hash", F.sha2("text", 256)), new_path(spark, "corpus"))
    anchors = corpus.anchors(files)
    counts = chunks.groupBy("corpus").agg(F.count("*").alias("chunks"))
    return anchors.join(files.groupBy("corpus").agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents")), "corpus").join(counts, "corpus", "left").select(
        "id", "title", "files", "contents", F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


def v02_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The notes that single-note checks have to look at: those changed since the last scan, which saw bodies with one kind of line end."""
    notes = view(spark, folder, "title", "body")
    text = lambda body: F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), body), 256)
    now = notes.select(F.col("id").alias("key"), text(F.col("body")).alias("hash"))
    was = notes.filter("id not like 'drift-%'").select(F.col("id").alias("key"), text(F.replace("body", F.lit("\r\n"), F.lit("\n"))).alias("hash"))
    return review.to_scan(was, now).select(F.col("key").alias("id"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "sv" and k[1:3].isdigit()}

_CHUNKS = SECTIONS["c02_heading_chunks"]
_HASH = "sha256(coalesce(title, '') || '|' || {0})"

SQL = {
    "s01_parsed_notes": f"""with {NOTES}, r as (select distinct on (id) id, external_refs from notes where id is not null order by id)
select n.id, type, array_to_string(tags, ',') as tags, round(weight, 6) as weight, array_to_string(acceptance, ';') as acceptance, len(list_filter(coalesce(acceptance_met, []), lambda x: x)) as n_met,
  coalesce(len(external_refs), 0) as n_refs, md5(body) as hash, 'alpha' as origin_scope from n join r using (id) where not ends_with(n.id, 'a')""",
    "s18_access_lines": """select mote_id, count(*) as n, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') as last, count(*) filter (primed) as primed from access_log where mote_id is not null and accessed_at is not null group by 1""",
    "s20_proposal_lines": f"with {NOTES} select id, 'medium' as severity, len(informed_by) as n_targets, round(weight, 6) as confidence from n where len(tags) > 0 and coalesce(title, '') <> ''",
    "s24_export": f"with {NOTES} select id, title, array_to_string(tags, ',') as tags, md5(body) as hash from n where type = 'task' and list_contains(tags, 'backend')",
    "s25_import": f"""with {NOTES}, x as (select id, type, status, sha256(coalesce(type, '') || coalesce(title, '') || body) as h from n)
select id, type from x where h not in (select h from x where status = 'completed') qualify row_number() over (partition by h order by id) = 1""",
    "s12_ingest": f"""with d as (select coalesce(lower(trim(lang)), 'none') as corpus, doc_id, coalesce(text, '') as text from documents), c as (select corpus, count(*) as chunks from d join ({_CHUNKS}) k on k.id = d.doc_id group by corpus)
select 'anchor-' || d.corpus as id, 'Reference: ' || d.corpus as title, count(*) as files, count(distinct text) as contents, coalesce(any_value(chunks), 0) as chunks from d left join c using (corpus) group by d.corpus""",
    "v02_scan": f"""with {NOTES}, x as (select id, {_HASH.format('body')} as h, case when id not like 'drift-%' then {_HASH.format("replace(body, chr(13) || chr(10), chr(10))")} end as o from n), c as (select id from x where h is distinct from o)
select id from x where id in (select id from c) or (select count(*) from c) = 0""",
}
