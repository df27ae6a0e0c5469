"""Queries of text retrieval, chunking, logs and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import chunks, graph, logs, retrieval, review
from notegraph.operators.components import connected_components
from notegraph.operators.notes import view
from notegraph.operators.order import quantiles
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, NOTES
from notegraph.scratch import materialize, settled
from notegraph.sources.tables import folded, table, version

MERGE_SCORE = 2.0


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def _note_texts(spark: SparkSession, folder: str) -> DataFrame:
    notes = view(spark, folder, "title", "body", where="status <> 'deprecated'")
    return notes.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")).alias("text"))


def doc_index(spark: SparkSession, folder: str) -> retrieval.Index:
    return retrieval.kept_index(_docs(spark, folder), "documents", version(spark, folder, "documents"))


def note_index(spark: SparkSession, folder: str) -> retrieval.Index:
    """The index of the notes that are not deprecated."""
    return retrieval.kept_index(_note_texts(spark, folder), "notes", version(spark, folder, "notes"))


def x01_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.search_tokens(F.col("text"))
    return _docs(spark, folder).select("id", F.size(tokens).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct"))


def x02_keywords(spark: SparkSession, folder: str) -> DataFrame:
    words = tx.keywords(F.col("text"))
    return _docs(spark, folder).select("id", F.size(words).cast("bigint").alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("hash"))


def x04_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("id", tx.estimated_tokens(F.col("text")).cast("bigint").alias("by_words"), tx.byte_tokens(F.col("text")).alias("by_bytes"))


def s30_hooks(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "body").select("id", tx.body_hook(F.col("body")).alias("hook"))


def s23_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Number and depth of the headings of each document."""
    heads = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^(#{1,4})[ \t]+\S"), F.lit(1))
    rows = _docs(spark, folder).select("id", F.explode(heads).alias("head"))
    return rows.groupBy("id").agg(F.count("*").alias("n_sections"), F.max(F.length("head")).cast("bigint").alias("deepest"))


def s15_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """States of the documents against an index built before February from texts with unified line ends."""
    docs = table(spark, folder, "documents")
    now = docs.select(F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    early = docs.filter("stored_at < timestamp_ntz'2017-02-01 00:00:00'")
    was = early.select(F.col("doc_id").alias("key"), F.md5(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))).alias("hash"))
    return review.changed_rows(was, now)


def s25_first_copies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return review.keep_first(docs, F.sha2(text, 256), "doc_id")


def r01_postings(spark: SparkSession, folder: str) -> DataFrame:
    index = doc_index(spark, folder)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def r02_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for the text of each reading sample."""
    queries = table(spark, folder, "reading_samples").select(F.col("sample_id").alias("query_id"), "text")
    found = retrieval.search(doc_index(spark, folder), queries, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def r02_document_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for the text of every twentieth one; r02_search has the reading samples as queries."""
    docs = _docs(spark, folder)
    queries = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "text")
    found = retrieval.search(doc_index(spark, folder), queries, 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def r03_similar(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.similar(note_index(spark, folder))
    return found.select("src", "id", F.round("score", 6).alias("score"), "rank")


def r04_distinctive(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.distinctive_terms(note_index(spark, folder))
    return found.select("id", "term", F.round("weight", 6).alias("weight"), "rank")


def r10_content_links(spark: SparkSession, folder: str) -> DataFrame:
    """Similar notes that no edge links yet, the smaller id first, with the better of the two scores."""
    index = note_index(spark, folder)
    found = retrieval.similar(index, 3, retrieval.thresholds(index.n_docs)[1])
    pairs = found.groupBy(F.least("src", "id").alias("a"), F.greatest("src", "id").alias("b")).agg(F.max("score").alias("score"))
    edges = graph.live_edges(table(spark, folder, "edges"))
    linked = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti").select("a", "b", F.round("score", 6).alias("score"))


def g11_merge_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Connected groups of at least three notes that are very similar, by their smallest id."""
    found = retrieval.similar(note_index(spark, folder), 5, MERGE_SCORE)
    links = materialize(found.select(F.col("src").alias("a"), F.col("id").alias("b")), "similar")
    sized = connected_components(links).groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))
    return sized.filter("n >= 3")


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "concept_entries").select(folded(F.col("term")).alias("text")).filter("text <> ''").distinct()
    return terms.select(F.col("text").alias("query_id"), "text")


def _seeds(spark: SparkSession, folder: str, bm25: bool = False) -> DataFrame:
    notes = view(spark, folder, "tags", "title", "body")
    refs = graph.live_edges(table(spark, folder, "edges")).filter("edge_type = 'concept_ref'").select("source", "target")
    texts = notes.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")).alias("text"))
    return retrieval.seeds(_topics(spark, folder), notes, refs, index=retrieval.build_index(texts) if bm25 else None)


def r16_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds without the text search; r16_searched_seeds has them with it."""
    return _seeds(spark, folder).select("query_id", "id", F.round("strength", 6).alias("strength"), "seed_pos")


def r16_searched_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _seeds(spark, folder, bm25=True).select("query_id", "id", F.round("strength", 6).alias("strength"), "seed_pos")


def g05_context(spark: SparkSession, folder: str) -> DataFrame:
    """For every concept term: its seed notes and what is found around them within two hops."""
    return _context(spark, folder)


def g05_searched_context(spark: SparkSession, folder: str) -> DataFrame:
    """The same around the seeds that count the text search too."""
    return _context(spark, folder, bm25=True)


def _context(spark: SparkSession, folder: str, bm25: bool = False) -> DataFrame:
    seeds = settled(lambda: _seeds(spark, folder, bm25), "seeds")
    notes = view(spark, folder, "weight", "status", "origin", "type", "access_count", "last_accessed")
    found = graph.traverse(seeds, notes, graph.live_edges(table(spark, folder, "edges")), AS_OF)
    return found.select("query_id", "id", "hop", F.round("score", 6).alias("score"), "rank")


def c02_heading_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.heading_chunks(_docs(spark, folder)).select("id", "idx", "heading", F.md5("text").alias("hash"))


def c03_function_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.function_chunks(_docs(spark, folder)).select("id", "idx", "heading", F.md5("text").alias("hash"))


def c04_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.sliding_chunks(_docs(spark, folder)).select("id", "idx", F.md5("text").alias("hash"))


def a09_flush(spark: SparkSession, folder: str) -> DataFrame:
    flushed = logs.flush_accesses(view(spark, folder, "access_count", "last_accessed"), table(spark, folder, "access_log"))
    return flushed.select("id", F.col("access_count").cast("bigint").alias("access_count"), F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last_accessed"))


def a10_hit_rates(spark: SparkSession, folder: str) -> DataFrame:
    rates = logs.hit_rates(table(spark, folder, "access_log"))
    return rates.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "primed_count", "hit_count", F.round("hit_rate", 6).alias("hit_rate"))


def a23_dominant(spark: SparkSession, folder: str) -> DataFrame:
    return logs.dominant_notes(table(spark, folder, "access_log"), sessions=35, min_primed=4)


def _query_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("corpus"), F.col("user_id").cast("string").alias("query"), "value", "event_id")


def a21_frequent_queries(spark: SparkSession, folder: str) -> DataFrame:
    log = _query_log(spark, folder)
    return logs.frequent_queries(log, log.filter("value > 90").select("corpus", "query"), 12, 8)


def a25_feedback(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "F").alias("checked"),
        (F.col("l_quantity") > 25).alias("persisted"), (F.col("l_tax") - 0.04).alias("delta"),
    )
    stats = logs.feedback_stats(rows)
    return stats.select("kind", "total", "checked", "persisted", "reverted", *[F.round(c, 6).alias(c) for c in ("avg_delta", "positive_pct", "avg_confidence")])


def a26_configs(spark: SparkSession, folder: str) -> DataFrame:
    ledger = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("config"), (F.col("o_orderkey") % 12).alias("batches"), (F.col("o_custkey") % 9).alias("proposals"), (F.col("o_totalprice") / 1e5).alias("cost")
    )
    table_ = logs.compare_configs(ledger)
    return table_.select("config", "cycles", *[F.round(c, 6).alias(c) for c in ("avg_per_batch", "avg_cost", "avg_cost_per_proposal")])


def a27_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Median and upper quartile of the similarity scores, kept within half and twice the adaptive threshold."""
    index = note_index(spark, folder)
    base = retrieval.thresholds(index.n_docs)[1]
    n, both = quantiles(retrieval.similar(index), "score", (0.5, 0.75))
    kept = [None if x is None else F.round(F.greatest(F.lit(base / 2), F.least(F.lit(base * 2), F.lit(x))), 6) for x in both]
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), *[(F.lit(None).cast("double") if x is None else x).alias(c) for x, c in zip(kept, ("p50", "p75"))])


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals read off the edge log: each edge line proposes a link; lines repeat or are withdrawn like runs do."""
    log = table(spark, folder, "edges")
    return log.select(
        F.lit("link_suggestion").alias("kind"), F.lit("add").alias("action"), F.array("source").alias("sources"), F.array("target").alias("targets"),
        F.when(F.col("edge_type").isin("blocks", "depends_on"), "dependency").otherwise("reference").alias("link_type"),
        F.when(F.col("deleted"), "high").otherwise("low").alias("severity"), F.concat_ws(" ", "source", "edge_type", "target").alias("rationale"), F.col("edge_type").alias("lens"),
    )


def v06_vote(spark: SparkSession, folder: str) -> DataFrame:
    voted = review.vote(_proposals(spark, folder), 3)
    return voted.withColumn("agreement", F.round("agreement", 6))


def v08_cross_lens(spark: SparkSession, folder: str) -> DataFrame:
    return review.cross_lens(_proposals(spark, folder))


def x24_confidence(spark: SparkSession, folder: str) -> DataFrame:
    stats = logs.feedback_stats(
        table(spark, folder, "edges").select(F.col("edge_type").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(True).alias("checked"), (~F.col("deleted")).alias("persisted"), F.lit(0.1).alias("delta"))
    )
    sure = review.confidence(
        review.history_score(F.col("total"), F.col("checked"), F.col("persisted"), F.col("positive_pct"), F.col("avg_delta")),
        F.lit(1.0), F.lit("medium"), F.lit(0.5), F.col("persisted") / F.col("total"),
    )
    return stats.select("kind", F.round(sure, 6).alias("confidence"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "acgrsvx" and k[1:3].isdigit()}

_NOTE_DOCS = f"select id, coalesce(title, '') || ' ' || body as text from ({{0}}) where status <> 'deprecated'"
_DOCS = "select doc_id as id, text from documents"
_ND = "select id, coalesce(title, '') || ' ' || body as text from n where status <> 'deprecated'"
_TOP = "top as (select *, row_number() over (partition by id order by round(tf * idf, 9) desc, term) as r from p join t using (term))"
_SIM = f"""{_TOP}, sim as (select top.id as src, p.id, sum({q.WEIGHT}) as score from top join t on t.term = top.term
  join p on p.term = top.term and p.id <> top.id where top.r <= 8 group by top.id, p.id)"""
_LE = "le as (select source, target, edge_type from edges group by all having not bool_or(coalesce(deleted, false)))"
_PRIMED = """pd as (select accessed_at::date as day, mote_id, bool_or(coalesce(primed, false)) as primed, bool_or(not coalesce(primed, false)) as hit
  from access_log where mote_id is not null and accessed_at is not null group by all), primed as (select * from pd where primed)"""
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WINDOW = schema.CHUNKING.window
_STEP = schema.CHUNKING.step


def _windows(words: str) -> str:
    return f"case when len({words}) = 0 then [] else list_transform(range(0, len({words}), {_STEP}), lambda s: array_to_string({words}[s + 1:s + {_WINDOW}], ' ')) end"


_SEEDS = f"""{NOTES}, {_LE},
topics as (select distinct lower(trim(term, {q.BLANK})) as text from concept_entries where trim(term, {q.BLANK}) <> ''),
asked as (select text as query_id, unnest({q.keyword_list('text')}) as word from topics),
strong as (
  select query_id, source as id, 1.0::double as s from asked join (select distinct source, target from le where edge_type = 'concept_ref') c on c.target = word
  union all select query_id, id, 1.0 from asked join (select distinct id, lower(tag) as tag from (select id, unnest(tags) as tag from n)) on tag = word),
body as (select id, unnest({q.keyword_list('body')}) as word from n),
every as (select * from strong union all select query_id, id, 0.3::double from asked join body using (word)
  union all select query_id, id, 0.5::double from asked, n where query_id not in (select query_id from strong) and contains(lower(coalesce(title, '')), word)),
seeds as (select * from (select query_id, id, sum(s) as strength, row_number() over (partition by query_id order by round(sum(s), 9) desc, id)::int as seed_pos
  from every group by query_id, id) where seed_pos <= 10)"""

_SEARCHED_SEEDS = _SEEDS.replace("seeds as (", q.bm25("select id, coalesce(title, '') || ' ' || body as text from n").strip() + f""",
terms as (select query_id, term, count(*) as times from (select text as query_id, unnest({q.tokens('text')}) as term from topics where text in (select query_id from asked)) group by all),
hits as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from terms join t using (term) join p using (term) group by all),
best as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from hits where score > 0),
all_signals as (select * from every union all select query_id, id, score / max(score) over (partition by query_id) * 0.5::double from best where r <= 20),
seeds as (""").replace("from every group", "from all_signals group")


def _hop(k: int, before: str, frontier: str) -> str:
    score = q.relevance("edge_type", "0.0::double", "disputed")
    return f"""near{k} as (select f.query_id, l.target as id, f.place as from_place, l.edge_type from {frontier} f join links l on l.source = f.id
  where not exists (select 1 from {before} b where b.query_id = f.query_id and b.id = l.target)),
disp{k} as (select x.query_id, x.id, count(*) as disputed from (select distinct query_id, id from near{k}) x join links c on c.source = x.id and c.edge_type = 'contradicts'
  join {before} b on b.query_id = x.query_id and b.id = c.target join n on n.id = b.id and n.status <> 'deprecated' group by all),
scored{k} as (select near{k}.query_id, near{k}.id, from_place, edge_type, {score} as score from near{k} join n using (id)
  left join (select query_id, id, disputed as hits from disp{k}) h on h.query_id = near{k}.query_id and h.id = near{k}.id, lateral (select coalesce(hits, 0) as disputed)),
pick{k} as (select * from scored{k} where score >= 0.25::double qualify row_number() over (partition by query_id, id order by from_place, edge_type) = 1),
hop{k} as (select query_id, id, {k} as hop, row_number() over (partition by query_id order by from_place, edge_type, id) as place, score from pick{k})"""


SQL = {
    "x01_tokens": f"select id, len(k)::bigint as n_tokens, len(list_distinct(k))::bigint as n_distinct from (select doc_id as id, {q.tokens('text')} as k from documents)",
    "x02_keywords": f"select id, len(k)::bigint as n_words, md5(array_to_string(list_sort(k), ' ')) as hash from (select doc_id as id, {q.keyword_list('text')} as k from documents)",
    "x04_estimates": f"select doc_id as id, trunc(len({q.fields('text')}) * 1.3::double)::bigint as by_words, (strlen(coalesce(text, '')) // 4)::bigint as by_bytes from documents",
    "s30_hooks": f"""with {NOTES}, x as (select id, list_filter(list_transform(string_split(body, chr(10)), lambda v: trim(v, ' ' || chr(9) || chr(13))),
  lambda v: v <> '' and not starts_with(v, '#'))[1] as line from n), y as (select id, regexp_replace(regexp_replace(line, '^[-*] ', ''), '\\*\\*|__', '', 'g') as line from x)
select id, coalesce(case when length(line) > 120 then left(line, 117) || '...' else line end, '') as hook from y""",
    "s23_sections": r"""with x as (select doc_id as id, regexp_extract_all(coalesce(text, ''), '(?m)^(#{1,4})[ \t]+\S', 1) as h from documents)
select id, len(h)::bigint as n_sections, list_max(list_transform(h, lambda v: length(v)))::bigint as deepest from x where len(h) > 0""",
    "s15_refresh": """with o as (select doc_id as key, md5(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) as h from documents where stored_at < timestamp '2017-02-01 00:00:00'),
w as (select doc_id as key, md5(coalesce(text, '')) as h from documents)
select coalesce(o.key, w.key) as key, case when o.h is null then 'added' when w.h is null then 'removed' when o.h <> w.h then 'changed' else 'same' end as state from o full join w on o.key = w.key""",
    "s25_first_copies": "select min(doc_id) as first, count(*) as copies from documents group by sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, ''))",
    "r01_postings": f"with {q.bm25(_DOCS)} select term, df, round(idf, 6) as idf from t",
    "r02_search": f"""with {q.bm25(_DOCS)}, a as (select sample_id as query_id, term, count(*) as times from (select sample_id, unnest({q.tokens('text')}) as term from reading_samples) group by all),
x as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from a join t using (term) join p using (term) group by all)
select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from x where score > 0) where r <= 10""",
    "r02_document_search": f"""with {q.bm25(_DOCS)}, a as (select doc_id as query_id, term, count(*) as times from (select doc_id, unnest({q.tokens('text')}) as term from documents where doc_id % 20 = 0) group by all),
x as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from a join t using (term) join p using (term) group by all)
select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from x where score > 0) where r <= 10""",
    "r03_similar": f"""with {NOTES}, {q.bm25(_ND)}, {_SIM}
select src, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= 1.0) where r <= 3""",
    "r04_distinctive": f"with {NOTES}, {q.bm25(_ND)}, {_TOP} select id, term, round(tf * idf, 6) as weight, r::int as rank from top where r <= 8",
    "r10_content_links": f"""with {NOTES}, {q.bm25(_ND)}, {_SIM}, {_LE},
lim as (select least(greatest(ln((n_docs - 0.5) / 1.5 + 1) / ln((50 - 0.5) / 1.5 + 1), 0.15), 3.0) as m from s),
best as (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= (select m from lim)),
pairs as (select least(src, id) as a, greatest(src, id) as b, max(score) as score from best where r <= 3 group by all)
select a, b, round(score, 6) as score from pairs where not exists (select 1 from le where least(source, target) = a and greatest(source, target) = b)""",
    "g11_merge_clusters": f"""with recursive {NOTES}, {q.bm25(_ND)}, {_SIM},
best as (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= {MERGE_SCORE}),
e as (select src as a, id as b from best where r <= 5 union select id, src from best where r <= 5),
reach(node, other) as (select a, b from e union select reach.node, e.b from reach join e on e.a = reach.other),
comp as (select node, least(node, min(other)) as component from reach group by node)
select component, count(*) as n, max(node) as last from comp group by component having count(*) >= 3""",
    "r16_seeds": f"with {_SEEDS} select query_id, id, round(strength, 6) as strength, seed_pos from seeds",
    "g05_context": f"""with {_SEEDS}, links as (select * from le where edge_type <> 'concept_ref'),
v0 as (select query_id, id, 0 as hop, seed_pos::bigint as place, {q.relevance(chr(39) + 'seed' + chr(39), '0.0::double', '0')} as score from seeds join n using (id)),
{_hop(1, 'v0', 'v0')}, v1 as (select * from v0 union all select * from hop1), {_hop(2, 'v1', 'hop1')}, v2 as (select * from v1 union all select * from hop2)
select query_id, id, hop::int as hop, round(score, 6) as score, r::int as rank
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from v2) where r <= 12""",
    "r16_searched_seeds": f"with {_SEARCHED_SEEDS} select query_id, id, round(strength, 6) as strength, seed_pos from seeds",
    "g05_searched_context": f"""with {_SEARCHED_SEEDS}, links as (select * from le where edge_type <> 'concept_ref'),
v0 as (select query_id, id, 0 as hop, seed_pos::bigint as place, {q.relevance(chr(39) + 'seed' + chr(39), '0.0::double', '0')} as score from seeds join n using (id)),
{_hop(1, 'v0', 'v0')}, v1 as (select * from v0 union all select * from hop1), {_hop(2, 'v1', 'hop1')}, v2 as (select * from v1 union all select * from hop2)
select query_id, id, hop::int as hop, round(score, 6) as score, r::int as rank
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from v2) where r <= 12""",
    "c02_heading_chunks": f"""with x as (select doc_id as id, unnest(string_split(replace(coalesce(text, ''), chr(10) || '#', chr(1) || '#'), chr(1))) as sec,
  generate_subscripts(string_split(replace(coalesce(text, ''), chr(10) || '#', chr(1) || '#'), chr(1)), 1) as i from documents),
y as (select id, i, trim(regexp_extract(sec, '^#+([^\\n]*)', 1), {_STRIP}) as heading, trim(sec, {_STRIP}) as whole from x),
z as (select *, {q.fields('whole')} as w from y where whole <> ''),
parts as (select id, i, heading, case when trunc(len(w) * 1.3::double) > 512 then {_windows('w')} else [whole] end as texts from z),
u as (select id, i, heading, unnest(texts) as t, generate_subscripts(texts, 1) as j from parts)
select id, (row_number() over (partition by id order by i, j) - 1)::int as idx, heading, md5(t) as hash from u""",
    "c03_function_chunks": f"""with f as (select doc_id as id, coalesce(text, '') as text, regexp_matches(coalesce(text, ''), '(?:\\A|\\n)(?:{schema.FUNCTION_STARTS})') as code from documents),
x as (select id, string_split(regexp_replace(text, '\\n({schema.FUNCTION_STARTS})', chr(1) || '\\1', 'g'), chr(1)) as secs from f where code),
y as (select id, unnest(secs) as sec, generate_subscripts(secs, 1) as i from x),
z as (select id, i, case when regexp_matches(sec, '\\A(?:{schema.FUNCTION_STARTS})') then trim(split_part(sec, chr(10), 1), {_STRIP}) else '' end as heading, trim(sec, {_STRIP}) as t from y),
w as (select id, {q.fields('text')} as w from f where not code), pl as (select id, {_windows('w')} as texts from w),
u as (select id, i, heading, t from z where t <> '' union all select id, generate_subscripts(texts, 1), '', unnest(texts) from pl)
select id, (row_number() over (partition by id order by i) - 1)::int as idx, heading, md5(t) as hash from u""",
    "c04_windows": f"""with w as (select doc_id as id, {q.fields('text')} as w from documents), x as (select id, {_windows('w')} as texts from w)
select id, (i - 1)::int as idx, md5(t) as hash from (select id, unnest(texts) as t, generate_subscripts(texts, 1) as i from x)""",
    "a09_flush": f"""with {NOTES}, c as (select mote_id as id, count(*) as k, max(accessed_at) as last from access_log where mote_id is not null and accessed_at is not null group by 1)
select n.id, (access_count + coalesce(k, 0))::bigint as access_count, strftime(coalesce(last, last_accessed), '%Y-%m-%d %H:%M:%S') as last_accessed from n left join c using (id)""",
    "a10_hit_rates": f"""with {_PRIMED} select strftime(day, '%Y-%m-%d') as day, count(*) as primed_count, count(*) filter (hit) as hit_count,
  round(count(*) filter (hit) / count(*), 6) as hit_rate from primed group by day""",
    "a23_dominant": f"""with {_PRIMED}, recent as (select distinct day from primed order by day desc limit 35)
select mote_id, count(*) as primed, count(*) filter (hit) as hits from primed where day in (select day from recent) group by mote_id having count(*) >= 4 and count(*) filter (hit) / count(*) < 0.6""",
    "a21_frequent_queries": """with l as (select event_type as corpus, user_id::varchar as query, value from events), b as (select distinct corpus, query, true as useful from l where value > 90),
c as (select corpus, query, count(*) as n from l group by all) select corpus, query, n from c left join b using (corpus, query) where n >= 12 or (useful and n >= 8)""",
    "a25_feedback": """with f as (select l_returnflag as kind, l_discount as confidence, l_linestatus = 'F' as checked, l_quantity > 25 as persisted, l_tax - 0.04::double as delta from lineitem)
select kind, count(*) as total, count(*) filter (checked) as checked, count(*) filter (checked and persisted) as persisted, count(*) filter (checked and not persisted) as reverted,
  round(case when count(*) filter (checked) > 0 then sum(delta) filter (checked) / count(*) filter (checked) else 0.0 end, 6) as avg_delta,
  round(case when count(*) filter (checked) > 0 then 100.0::double * count(*) filter (checked and delta > 0) / count(*) filter (checked) else 0.0 end, 6) as positive_pct,
  round(avg(confidence), 6) as avg_confidence from f group by kind""",
    "a26_configs": """with l as (select o_orderpriority as config, o_orderkey % 12 as b, o_custkey % 9 as v, o_totalprice / 1e5 as cost from orders)
select config, count(*) as cycles, round(avg(case when b > 0 then v / b else 0.0 end), 6) as avg_per_batch, round(avg(cost), 6) as avg_cost,
  round(coalesce(avg(case when v > 0 and cost > 0 then cost / v end), 0.0), 6) as avg_cost_per_proposal from l group by config""",
    "a27_calibration": f"""with {NOTES}, {q.bm25(_ND)}, {_SIM},
lim as (select least(greatest(ln((n_docs - 0.5) / 1.5 + 1) / ln((50 - 0.5) / 1.5 + 1), 0.15), 3.0) as m from s),
best as (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= 1.0),
a as (select count(*) as n, quantile_cont(score, 0.5) as p50, quantile_cont(score, 0.75) as p75 from best where r <= 3)
select n, round(greatest(m / 2, least(m * 2, p50)), 6) as p50, round(greatest(m / 2, least(m * 2, p75)), 6) as p75 from a, lim""",
    "v06_vote": """with x as (select 'link_suggestion|add|' || source || '|' || target || '|' || case when edge_type in ('blocks', 'depends_on') then 'dependency' else 'reference' end as key,
  source, target, case when deleted then 'high' else 'low' end as severity, source || ' ' || edge_type || ' ' || target as rationale from edges)
select key, count(*) as votes, round(count(*) / 3, 6) as agreement, min(severity) as severity,
  '[' || count(*) || '/3 runs agreed] ' || arg_max(rationale, {'n': strlen(rationale), 'r': rationale}) as rationale, any_value(source) as sources, any_value(target) as targets
from x group by key having count(*) >= 2""",
    "v08_cross_lens": """with x as (select distinct 'link_suggestion|add|' || source || '|' || target || '|' || case when edge_type in ('blocks', 'depends_on') then 'dependency' else 'reference' end as key, edge_type as lens from edges)
select key, string_agg(lens, ',' order by lens) as lenses from x group by key having count(*) >= 2""",
    "x24_confidence": """with s as (select edge_type as kind, count(*) as total, count(*) filter (not deleted) as kept from edges group by 1)
select kind, round(0.35::double * ((kept / total + 1.0 + 0.6) / 3.0) + 0.20::double + 0.6::double * 0.15 + 0.5::double * 0.10 + kept / total * 0.20::double, 6) as confidence from s""",
}
