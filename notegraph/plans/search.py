"""Queries of retrieval end to end: chunk tables and corpora, stored indexes, prompts, links for new notes, what to show at a start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import chunks as ch, graph, retrieval
from notegraph.operators.notes import view
from notegraph.plans import retrieval as base
from notegraph.plans import sqlparts as q
from notegraph.plans.sqlparts import AS_OF, NOTES
from notegraph.scratch import drop, new_path, settled
from notegraph.sources import corpus as files
from notegraph.sources.tables import table, version

_WEIGHTS = ("weight", "status", "origin", "type", "access_count", "last_accessed")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """corpus, id, source_path, heading, text of the documents' sections; the corpus is the scope of the project."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.nullif(tx.scope_of(F.col("project")), F.lit("")), F.lit("none")).alias("corpus"), "text")
    parts = ch.heading_chunks(docs).join(docs.select("id", "corpus"), "id")
    return parts.select("corpus", F.concat_ws("-", "corpus", "id", "idx").alias("id"), F.concat(F.lit("doc/"), "id").alias("source_path"), "heading", "text")


def _corpora(spark: SparkSession, folder: str) -> tuple[DataFrame, retrieval.Corpora]:
    """The stored chunk table and the indexes of its corpora."""
    path = new_path(spark, "chunks")
    files.save_chunks(_chunks(spark, folder), path)
    held = files.load_chunks(spark, path)
    return held, retrieval.build_corpora(held)


def _indexed(spark: SparkSession, folder: str) -> retrieval.Corpora:
    """The indexes alone; they hold what searches need, so the chunk table goes."""
    path = new_path(spark, "chunks")
    files.save_chunks(_chunks(spark, folder), path)
    corpora = retrieval.build_corpora(files.load_chunks(spark, path))
    drop(spark, path)
    return corpora


def s14_chunk_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk tables of all corpora, written and read again, and their manifests."""
    path = new_path(spark, "chunks")
    files.save_chunks(_chunks(spark, folder), path)
    return files.manifest(files.load_chunks(spark, path))


def s16_union_of_paths(spark: SparkSession, folder: str) -> DataFrame:
    """What ensuring a corpus over old and new paths has to do: documents stored early make the old manifest, those of some kinds
    are the paths asked for now."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "kind", "stored_at")
    old = docs.filter("stored_at < timestamp_ntz'2017-02-01 00:00:00'").select("path", F.when(F.col("kind") == "task", F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    asked = docs.filter("kind in ('task', 'decision')").select("path")
    return files.ensured(old, asked, docs.filter("kind <> 'lesson' or kind is null").select("path", "hash"))


def r06_stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the notes' index after it was written and read again."""
    path = new_path(spark, "index")
    retrieval.save_index(base.note_index(spark, folder), path)
    index = retrieval.load_index(spark, path)
    held = index.postings.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("tf"), 6).alias("tf"))
    return index.terms.join(held, "term").select("term", "df", "n", "tf", F.round("idf", 6).alias("idf"), F.lit(index.n_docs).cast("bigint").alias("n_docs"))


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    return base._topics(spark, folder)


def r08_corpus_query(spark: SparkSession, folder: str) -> DataFrame:
    """The two best chunks of every corpus for every concept term, with heading and text."""
    held, corpora = _corpora(spark, folder)
    found = retrieval.search_corpora(corpora, _topics(spark, folder), 2)
    full = found.join(held.select("id", "heading", "text"), "id")
    return full.select("query_id", "corpus", "id", "heading", F.md5("text").alias("hash"), F.round("score", 6).alias("score"), "rank")


def r08_query_log(spark: SparkSession, folder: str) -> DataFrame:
    """What each of these searches adds to the log of queries."""
    found = retrieval.search_corpora(_indexed(spark, folder), _topics(spark, folder), 2)
    log = found.groupBy("query_id", "corpus").agg(F.count("*").alias("results_count"), F.min_by("id", "rank").alias("top_chunk_id"), F.max("score").alias("top_score"))
    return log.select("query_id", "corpus", "results_count", "top_chunk_id", F.round("top_score", 6).alias("top_score"))


def l04_all_corpora(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.merged(retrieval.search_corpora(_indexed(spark, folder), _topics(spark, folder), 3), 3)
    return found.select("query_id", "corpus", "id", F.round("score", 6).alias("score"), "rank")


def r12_code_context(spark: SparkSession, folder: str) -> DataFrame:
    """The three best chunks for the names in the changed files of each project; a project has one file for each kind."""
    docs = table(spark, folder, "documents").filter("project is not null and kind is not null").select("project", "kind").distinct()
    paths = docs.groupBy("project").agg(F.collect_list(F.concat(F.lit("src/"), "project", F.lit("/"), "kind", F.lit("_notes.py"))).alias("paths"))
    asked = paths.select(F.col("project").alias("query_id"), F.array_join(tx.file_keywords(F.slice(F.array_sort("paths"), 1, 10)), " ").alias("text"))
    found = retrieval.merged(retrieval.search_corpora(_indexed(spark, folder), asked, 3), 3)
    return found.select("query_id", "corpus", "id", F.round("score", 6).alias("score"), "rank")


def x40_corpus_of_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus that each chunk's id names; of two scopes no name is known."""
    ids = _chunks(spark, folder)
    known = ids.select("corpus").distinct().filter("corpus not in ('atlas', 'ember')")
    return retrieval.corpus_of(ids, known)


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor notes, each of the corpus of its scope."""
    notes = view(spark, folder, "type", "title").filter("type = 'anchor'")
    return notes.select("id", tx.scope_of(F.col("id")).alias("corpus"), F.coalesce("title", F.lit("")).alias("hint"))


def j18_anchor_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors with the documents of their corpus and its three most frequent topics, the kinds of the documents."""
    docs = table(spark, folder, "documents").select(tx.scope_of(F.col("project")).alias("corpus"), "kind").filter("corpus <> ''")
    counts = docs.groupBy("corpus", "kind").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("corpus").agg(F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("n"), "kind")))).alias("kinds"))
    top = sizes.select("corpus", "n_docs", F.array_join(F.slice("kinds.kind", 1, 3), ",").alias("topics"))
    return _anchors(spark, folder).join(top, "corpus", "left").select("id", "corpus", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("topics", F.lit("")).alias("topics"))


def r07_auto_links(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that each question should point to."""
    fresh = view(spark, folder, "type", "title", "body", where="type = 'question' and status <> 'deprecated'")
    fresh = fresh.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "body").alias("text"))
    return retrieval.auto_links(base.note_index(spark, folder), fresh).select("id", "other", F.round("score", 6).alias("score"), "place")


def r09_prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    """Active notes to add to prompts, which are the texts of every twentieth document."""
    index = base.note_index(spark, folder)
    prompts = table(spark, folder, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = retrieval.prompt_context(index, prompts, view(spark, folder, "status"), retrieval.thresholds(index.n_docs)[0])
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "place")


def _task_topics(spark: SparkSession, folder: str) -> DataFrame:
    tasks = view(spark, folder, "title", "tags", where="type = 'task' and status = 'active'")
    return tasks.select(F.col("id").alias("query_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("tags", " ")).alias("text"))


def r13_corpus_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors whose title shares two keywords with the topic of an active task."""
    return retrieval.hinted(_task_topics(spark, folder), _anchors(spark, folder))


def _task_seeds(spark: SparkSession, folder: str, ambient: DataFrame | None = None, co_access: DataFrame | None = None) -> DataFrame:
    notes = view(spark, folder, "tags", "title", "body")
    refs = graph.live_edges(table(spark, folder, "edges")).filter("edge_type = 'concept_ref'").select("source", "target")
    texts = notes.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")).alias("text"))
    index = retrieval.kept_index(texts, "all-notes", version(spark, folder, "notes"))
    return retrieval.seeds(_task_topics(spark, folder), notes, refs, index=index, ambient=ambient, co_access=co_access)


def r17_ambient_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the active tasks with ambient texts: the scope as a branch, the source issue as a hint, the body as a prompt."""
    tasks = view(spark, folder, "body", "source_issue", where="type = 'task' and status = 'active'")
    around = F.array(*[F.struct(F.coalesce(t, F.lit("")).alias("text"), F.lit(b).alias("boost")) for t, b in ((tx.scope_of(F.col("id")), 0.5), (F.col("source_issue"), 0.7), (F.col("body"), 0.8))])
    ambient = tasks.select(F.col("id").alias("query_id"), F.inline(around))
    return _task_seeds(spark, folder, ambient).select("query_id", "id", F.round("strength", 6).alias("strength"), "seed_pos")


def r18_co_access_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the active tasks where notes about infra raise those about config and backend."""
    signal = spark.createDataFrame([("ops", ["infra"], ["config", "backend"], 0.3)], "name string, trigger array<string>, boosted array<string>, boost double")
    return _task_seeds(spark, folder, co_access=signal).select("query_id", "id", F.round("strength", 6).alias("strength"), "seed_pos")


def _task_context(spark: SparkSession, folder: str) -> DataFrame:
    seeds = settled(lambda: _task_seeds(spark, folder), "seeds")
    return graph.traverse(seeds, view(spark, folder, *_WEIGHTS), graph.live_edges(table(spark, folder, "edges")), AS_OF)


def l06_reranked(spark: SparkSession, folder: str) -> DataFrame:
    """The context of each active task, done tasks and deprecated notes lower."""
    found = retrieval.reranked(_task_context(spark, folder), view(spark, folder, "type", "status"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def r11_echoes(spark: SparkSession, folder: str) -> DataFrame:
    """Live notes similar to a concept term's seeds."""
    index = base.note_index(spark, folder)
    alike = retrieval.similar(index, 3, retrieval.thresholds(index.n_docs)[1])
    live = view(spark, folder, "status").filter(F.col("status").isin(*schema.LIVE))
    return retrieval.echoes(settled(lambda: base._seeds(spark, folder).select("query_id", "id"), "seeds"), alike, live)


def r14_augmented(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the corpora to which anchors in a task's context point."""
    anchors = view(spark, folder, "type").filter("type in ('anchor', 'explore')").select("id", tx.scope_of(F.col("id")).alias("corpus"))
    context = settled(lambda: _task_context(spark, folder).select("query_id", "id", "rank"), "context")
    found = retrieval.augmented(context, anchors, _indexed(spark, folder), _task_topics(spark, folder))
    return found.select("query_id", "corpus", "id", F.round("score", 6).alias("score"), "rank")


def r19_prime(spark: SparkSession, folder: str) -> DataFrame:
    """What to show when work on an active task starts: the task, its context and the live notes that echo it."""
    found = settled(lambda: _task_context(spark, folder).select("query_id", "id", "score"), "context")
    index = base.note_index(spark, folder)
    alike = retrieval.similar(index, 3, retrieval.thresholds(index.n_docs)[1])
    live = view(spark, folder, "status").filter(F.col("status").isin(*schema.LIVE))
    start = _task_topics(spark, folder).select("query_id", F.col("query_id").alias("id"))
    around = found.select("query_id", "id").unionByName(start).distinct()
    echo = retrieval.echoes(around, alike, live).select("query_id", "id", F.lit("echo").alias("part"), "score")
    return found.select("query_id", "id", F.lit("context").alias("part"), F.round("score", 6).alias("score")).unionByName(echo)


def r20_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of each active task, ranked again, with the contradictions inside it."""
    found = settled(lambda: retrieval.reranked(_task_context(spark, folder), view(spark, folder, "type", "status")), "context")
    disputes = graph.disputed_within(found, graph.live_edges(table(spark, folder, "edges")), view(spark, folder, "status"))
    rows = found.join(disputes, ["query_id", "id"], "left")
    return rows.select("query_id", "id", F.round("score", 6).alias("score"), "rank", F.coalesce("disputed", F.lit(0)).alias("disputed"))


def j15_disputed(spark: SparkSession, folder: str) -> DataFrame:
    """Contradictions inside the seeds of every concept term."""
    seeds = settled(lambda: base._seeds(spark, folder).select("query_id", "id"), "seeds")  # it meets itself, so it is found once
    return graph.disputed_within(seeds, graph.live_edges(table(spark, folder, "edges")), view(spark, folder, "status"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "jlrsx" and k[1:3].isdigit()}

_SCOPE = "case when instr({0}, '-') > 1 then split_part({0}, '-', 1) else '' end"
_CHUNKED = "select id, idx, heading, t as text from (" + base.SQL["c02_heading_chunks"].replace("heading, md5(t) as hash from u", "heading, t from u") + ")"
_CHUNKS = f"""docs as (select doc_id as id, coalesce(nullif({_SCOPE.format("coalesce(project, '')")}, ''), 'none') as corpus from documents),
chunks as (select corpus, corpus || '-' || id || '-' || idx as id, id as doc, heading, text from ({_CHUNKED}) join docs using (id))"""
_CORPORA = f"""{_CHUNKS}, cd as (select corpus, id, {q.tokens('text')} as toks from chunks), cs as (select corpus, count(*)::double as n_docs, sum(len(toks))::double / count(*) as avg_len from cd group by corpus),
cp as (select corpus, id, term, count(*)::double / any_value(k) as tf, any_value(k) as doc_len from (select corpus, id, len(toks) as k, unnest(toks) as term from cd) group by corpus, id, term),
ct as (select corpus, term, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) as idf, any_value(avg_len) as avg_len from cp join cs using (corpus) group by corpus, term)"""
_CW = "ct.idf * (cp.tf * (1.2::double + 1) / (cp.tf + 1.2::double * (1 - 0.75::double + 0.75::double * cp.doc_len / ct.avg_len)))"
_TERM_TOPICS = f"topics as (select distinct lower(trim(term, {q.BLANK})) as query_id, lower(trim(term, {q.BLANK})) as text from concept_entries where trim(term, {q.BLANK}) <> '')"


def _found(topics: str, k: int) -> str:
    return f"""{_CORPORA}, {topics}, ask as (select query_id, term, count(*) as times from (select query_id, unnest({q.tokens('text')}) as term from topics) group by all),
hit as (select query_id, cp.corpus, cp.id, sum(times * {_CW}) as score from ask join ct using (term) join cp on cp.corpus = ct.corpus and cp.term = ct.term group by all),
found as (select * from (select *, row_number() over (partition by query_id, corpus order by round(score, 9) desc, id)::int as rank from hit where score > 0) where rank <= {k})"""


def _merged(topics: str) -> str:
    return f"""with {_found(topics, 3)} select query_id, corpus, id, round(score, 6) as score, r::int as rank
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from found) where r <= 3"""


_FILES = """topics as (with f as (select project, 'src/' || project || '/' || kind || '_notes.py' as path from (select distinct project, kind from documents where project is not null and kind is not null) qualify row_number() over (partition by project order by path) <= 10),
w as (select distinct project, lower(regexp_replace(unnest(string_split(path, '/')), '\\.[^.]*$', '')) as w from f) select project as query_id, string_agg(w, ' ' order by w) as text from w where strlen(w) > 2 group by project)"""
_TASK_TOPICS = "topics as (select id as query_id, coalesce(title, '') || ' ' || array_to_string(tags, ' ') as text from n where type = 'task' and status = 'active')"


def _seeds(topics: str, more: str = "") -> str:
    sql = base._SEARCHED_SEEDS
    at, end = sql.index("topics as ("), sql.index("asked as (")
    sql = sql[:at] + topics + ",\n" + sql[end:]
    sql = sql.replace("select text as query_id, unnest", "select query_id, unnest").replace("where text in (select query_id from asked)", "where query_id in (select query_id from asked)")
    return sql.replace("best where r <= 20)", f"best where r <= 20{more})")


_LINKS = "links as (select * from le where edge_type <> 'concept_ref')"
_TASK_CONTEXT = f"""{_seeds(_TASK_TOPICS)}, {_LINKS}, v0 as (select query_id, id, 0 as hop, seed_pos::bigint as place, {q.relevance("'seed'", '0.0::double', '0')} as score from seeds join n using (id)),
{base._hop(1, 'v0', 'v0')}, v1 as (select * from v0 union all select * from hop1), {base._hop(2, 'v1', 'hop1')}, v2 as (select * from v1 union all select * from hop2),
ctx as (select query_id, id, hop, score, r::int as rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from v2) where r <= 12)"""
_AGAIN = """again as (select query_id, id, score * (case when type = 'task' and status = 'completed' then 0.5::double else 1.0::double end) * (case when status = 'deprecated' then 0.1::double else 1.0::double end) as score from ctx join n using (id)),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from again)"""


def _disputed(rows: str) -> str:
    return f"""dis as (select x.query_id, x.id, count(*) as disputed from {rows} x join le c on c.source = x.id and c.edge_type = 'contradicts' join {rows} y on y.query_id = x.query_id and y.id = c.target
  join n nx on nx.id = x.id and nx.status <> 'deprecated' join n ny on ny.id = y.id and ny.status <> 'deprecated' where x.id <> y.id group by all)"""


_LIM = "lim as (select least(greatest(ln((n_docs - 0.5) / 1.5 + 1) / ln((50 - 0.5) / 1.5 + 1), 0.15), 3.0) as m from s)"
# similar notes over the notes in force, beside the seeds' own index over all of them
_ALIKE = f"""alike as (with {NOTES}, {q.bm25(base._ND)}, {base._SIM}, {_LIM} select src, id from (select *, row_number() over (partition by src order by round(score, 9) desc, id) as r from sim where score >= (select m from lim)) where r <= 3)"""
_PM = "pm as (select least(greatest(2.0 * ln((n_docs - 0.5) / 1.5 + 1) / ln((50 - 0.5) / 1.5 + 1), 0.3), 6.0) as m from s)"


def _hits(topics: str) -> str:
    return f"""ask as (select query_id, term, count(*) as times from (select query_id, unnest({q.tokens('text')}) as term from ({topics})) group by all),
hit as (select query_id, p.id, sum(times * {q.WEIGHT}) as score from ask join t using (term) join p using (term) group by all),
top_hits as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from hit where score > 0)"""


SQL = {
    "s14_chunk_tables": f"""with {_CHUNKS} select corpus, count(*) as chunk_count, count(distinct doc) as n_files, sum(('0x' || substr(md5(id || '=' || text), 1, 8))::bigint)::bigint as checksum from chunks group by corpus""",
    "s16_union_of_paths": """with d as (select doc_id::varchar as path, md5(coalesce(text, '')) as hash, kind, stored_at from documents),
o as (select path, case when kind = 'task' then 'old' else hash end as hash from d where stored_at < timestamp '2017-02-01 00:00:00'), w as (select path from o union select path from d where kind in ('task', 'decision')),
f as (select path, hash from d where kind <> 'lesson' or kind is null)
select w.path, case when f.path is null then 'missing' when o.hash = f.hash then 'kept' when o.path is null then 'added' else 'changed' end as state from w left join o using (path) left join f using (path)""",
    "r06_stored_index": f"with {NOTES}, {q.bm25(base._ND)} select term, df, count(*) as n, round(sum(tf), 6) as tf, round(idf, 6) as idf, (select n_docs from s)::bigint as n_docs from p join t using (term) group by term, df, idf",
    "r08_corpus_query": f"with {_found(_TERM_TOPICS, 2)} select query_id, found.corpus, found.id, heading, md5(text) as hash, round(score, 6) as score, rank from found join chunks on chunks.id = found.id",
    "r08_query_log": f"with {_found(_TERM_TOPICS, 2)} select query_id, corpus, count(*) as results_count, arg_min(id, rank) as top_chunk_id, round(max(score), 6) as top_score from found group by query_id, corpus",
    "l04_all_corpora": _merged(_TERM_TOPICS),
    "r12_code_context": _merged(_FILES),
    "x40_corpus_of_chunk": f"with {_CHUNKS} select id, corpus from chunks",
    "j18_anchor_corpora": f"""with {NOTES}, c as (select {_SCOPE.format('project')} as corpus, kind, count(*) as k from documents where {_SCOPE.format('project')} <> '' group by all),
z as (select corpus, sum(k)::bigint as n_docs from c group by corpus), m as (select corpus, string_agg(kind, ',' order by k desc, kind) as topics from (select * from c where kind is not null qualify row_number() over (partition by corpus order by k desc, kind) <= 3) group by corpus)
select id, {_SCOPE.format('id')} as corpus, coalesce(n_docs, 0) as n_docs, coalesce(topics, '') as topics from n left join z on z.corpus = {_SCOPE.format('id')} left join m on m.corpus = z.corpus where type = 'anchor'""",
    "r07_auto_links": f"""with {NOTES}, {q.bm25(base._ND)}, {_hits("select id as query_id, coalesce(title, '') || ' ' || body as text from n where type = 'question' and status <> 'deprecated'")},
k as (select *, row_number() over (partition by query_id order by rank)::int as place from top_hits where rank <= 6 and query_id <> id and score >= 0.1) select query_id as id, id as other, round(score, 6) as score, place from k where place <= 5""",
    "r09_prompt_context": f"""with {NOTES}, {q.bm25(base._ND)}, {_PM}, pr as (select doc_id as query_id, {q.keyword_list('text')} as words from documents where doc_id % 20 = 0),
{_hits("select query_id, array_to_string(words, ' ') as text from pr where len(words) >= 3")}, k as (select *, row_number() over (partition by query_id order by rank)::int as place from top_hits
  where rank <= 5 and score >= (select m from pm) and id in (select id from n where status = 'active')) select query_id, id, round(score, 6) as score, place from k where place <= 3""",
    "r13_corpus_hints": f"""with {NOTES}, {_TASK_TOPICS}, k as (select query_id, unnest({q.keyword_list('text')}) as w from topics), a as (select id, unnest({q.keyword_list('title')}) as w from n where type = 'anchor')
select query_id, id, count(*) as n from k join a using (w) group by all having count(*) >= 2""",
    "r17_ambient_seeds": "with " + _seeds(_TASK_TOPICS, f""" union all select query_id, id, boost from (select distinct query_id, boost, w, g.id from (
    select id as query_id, boost, unnest({q.keyword_list('x')}) as w from (select id, unnest([{_SCOPE.format('id')}, coalesce(source_issue, ''), body]) as x, unnest([0.5::double, 0.7::double, 0.8::double]) as boost from n where type = 'task' and status = 'active'))
    join (select distinct id, lower(tag) as tag from (select id, unnest(tags) as tag from n)) g on g.tag = w)""") + " select query_id, id, round(strength, 6) as strength, seed_pos from seeds",
    "r18_co_access_seeds": "with " + _seeds(_TASK_TOPICS).replace("seeds as (select", """g as (select id, lower(tag) as tag from (select id, unnest(tags) as tag from n)),
raised as (select distinct query_id from all_signals a join g using (id) where g.tag = 'infra'),
with_boost as (select * from all_signals union all select query_id, id, 0.3::double from raised, g where g.tag in ('config', 'backend')), seeds as (select""").replace("from all_signals group", "from with_boost group") + " select query_id, id, round(strength, 6) as strength, seed_pos from seeds",
    "l06_reranked": f"with {_TASK_CONTEXT}, {_AGAIN} select query_id, id, round(score, 6) as score, rank from ranked",
    "r11_echoes": f"""with {base._SEEDS}, {_ALIKE} select distinct query_id, a.id, 0.15::double as score from seeds join alike a on a.src = seeds.id join n on n.id = a.id and n.status in ('active', 'in_progress')
where not exists (select 1 from seeds z where z.query_id = seeds.query_id and z.id = a.id)""",
    "r14_augmented": f"""with {_TASK_CONTEXT}, {_CORPORA}, ask as (select query_id, term, count(*) as times from (select query_id, unnest({q.tokens('text')}) as term from topics) group by all),
hit as (select query_id, cp.corpus, cp.id, sum(times * {_CW}) as score from ask join ct using (term) join cp on cp.corpus = ct.corpus and cp.term = ct.term group by all),
found as (select * from (select *, row_number() over (partition by query_id, corpus order by round(score, 9) desc, id)::int as rank from hit where score > 0) where rank <= 3 and score >= 0.3),
places as (select query_id, {_SCOPE.format('id')} as corpus, min(rank) as first_at from ctx join n using (id) where type in ('anchor', 'explore') group by all)
select query_id, corpus, id, round(score, 6) as score, rank from (select found.*, dense_rank() over (partition by query_id order by first_at, corpus) as o from found join places using (query_id, corpus)) where o <= 2""",
    "r19_prime": f"""with {_TASK_CONTEXT}, {_ALIKE}, around as (select query_id, id from ctx union select query_id, query_id from topics)
select query_id, id, 'context' as part, round(score, 6) as score from ctx union all select distinct a.query_id, k.id, 'echo', 0.15::double from around a join alike k on k.src = a.id
join n on n.id = k.id and n.status in ('active', 'in_progress') where not exists (select 1 from around z where z.query_id = a.query_id and z.id = k.id)""",
    "r20_context": f"with {_TASK_CONTEXT}, {_AGAIN}, {_disputed('ranked')} select query_id, id, round(score, 6) as score, rank, coalesce(disputed, 0) as disputed from ranked left join dis using (query_id, id)",
    "j15_disputed": f"with {base._SEEDS}, {_disputed('seeds')} select * from dis",
}
