"""Registered queries of the operators on text collections, and reference SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import cooccurrence, mixing, neardup, reading, terms, tokens
from notegraph.scratch import materialize
from notegraph.sources.tables import distinct_notes, folded, spread, table



def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "source", "text"))


# -- p1: near-duplicate notes ----------------------------------------------------------------------------------------------


def _similar_notes(spark: SparkSession, folder: str) -> neardup.Similar:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return neardup.near_duplicates(spread(table(spark, folder, "notes").select("id", "title", "body")), F.col("id"), text)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _similar_notes(spark, folder).pairs()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    similar = _similar_notes(spark, folder)
    return neardup.Similar(similar.members, materialize(similar.links, "links")).groups()


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """The alike pairs of classes of exact copies, each class by its smallest id; p1_groups has the members."""
    return _similar_notes(spark, folder).class_links().select("class_a", "class_b", F.round("similarity", 6).alias("similarity"))


# -- p2: frequency of tags and terms ---------------------------------------------------------------------------------------


def term_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """field, record, pos, token of the tags of notes and the terms of concept entries."""
    tags = distinct_notes(table(spark, folder, "notes"), "tags").select(F.col("id").alias("record"), F.posexplode("tags").alias("pos", "token"))
    entries = table(spark, folder, "concept_entries").select(F.col("mote_id").alias("record"), "pos", F.col("term").alias("token"))
    both = tags.select(F.lit("tags").alias("field"), "*").unionByName(entries.select(F.lit("term").alias("field"), "*"))
    return both.select("field", "record", "pos", folded(F.col("token")).alias("token")).filter("token <> ''")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).filter("mark is not null").select("field", "term", "mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(term_tokens(spark, folder), "tokens")
    return terms.marked_terms(terms.ngram_counts(rows), rows)


def p2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    counts = terms.ngram_counts(term_tokens(spark, folder))
    return counts.select("field", "n", F.array_join("gram", " | ").alias("gram"), "occurrences", "n_records")


# -- p5: tags that appear together -----------------------------------------------------------------------------------------


def _tag_pairs(spark: SparkSession, folder: str, min_count: int) -> DataFrame:
    return cooccurrence.pair_counts(cooccurrence.baskets(table(spark, folder, "notes"), F.col("id"), F.col("tags")), min_count)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _tag_pairs(spark, folder, 4)
    return pairs.filter(F.col("ab") * F.col("n_baskets") >= 3 * F.col("count_a") * F.col("count_b")).select(
        F.col("a").alias("tag_a"), F.col("b").alias("tag_b")
    )


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _tag_pairs(spark, folder, 1)
    return pairs.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "ab", "count_a", "count_b", "n_baskets", F.round("lift", 6).alias("lift"))


# -- p6: token ids ---------------------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("doc_id", tokens.encoder(spark)("text").alias("ids"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of tokens and bytes, and whether the ids decode to the bytes of the text."""
    ids = _texts(spark, folder).select("doc_id", "text", tokens.encoder(spark)("text").alias("ids"))
    back = ids.withColumn("raw", tokens.decoder(spark)("ids"))
    whole = tokens.text_or_empty(F.col("text"))
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.octet_length(whole).cast("bigint").alias("n_bytes"),
        (F.col("raw") == whole.cast("binary")).alias("exact"),
    )


# -- p7: mixing sources ----------------------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    documents = _texts(spark, folder)
    return materialize(mixing.sized(documents, tokens.token_counter(spark)("text")), "sizes")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    plan = materialize(mixing.mix_plan(sizes, table(spark, folder, "mix_targets")), "mix-plan")
    return mixing.short_sources(mixing.draw(sizes, plan), plan).select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    return mixing.mix(mixing.draw(sizes, mixing.mix_plan(sizes, table(spark, folder, "mix_targets"))))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    plan = materialize(mixing.mix_plan(sizes, table(spark, folder, "mix_targets")), "mix-plan")
    return mixing.mix_report(mixing.draw(sizes, plan), plan)


# -- p8: reading level -----------------------------------------------------------------------------------------------------


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(_texts(spark, folder), reading.train(table(spark, folder, "reading_samples")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).filter("band is not null").select("doc_id", "band")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p2_ngrams": p2_ngrams,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

_TRIM = "' ' || chr(9) || chr(10) || chr(13)"
_TOKENS = f"""
n as (select id, any_value(tags) as tags from notes where id is not null group by id),
tokens as (
  select 'tags' as field, id as record, i - 1 as pos, lower(trim(t, {_TRIM})) as token
    from (select id, unnest(tags) as t, generate_subscripts(tags, 1) as i from n)
  union select 'term', mote_id, pos, lower(trim(term, {_TRIM})) from concept_entries where mote_id is not null),
clean as (select * from tokens where token <> '')
"""
_TERMS = f"""{_TOKENS},
sized as (select field, count(distinct record) as n_all from clean group by field),
counted as (select field, token as term, count(*) as occurrences, count(distinct record) as n_records from clean group by all),
marked as (select field, term, occurrences, n_records,
  case when n_records <= 2 then 'rare' when 20 * n_records > n_all then 'common' end as mark from counted join sized using (field))
"""
_PAIRS = """n as (select id, any_value(title) as title, any_value(body) as body from notes where id is not null group by id),
words as (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\\p{L}\\p{N}]+') as w from n),
grams as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select id, w, unnest(generate_series(1, len(w) - 2)) as i from words where len(w) >= 3)),
sizes as (select id, count(*) as n from grams group by id),
shared as (select x.id as id_a, y.id as id_b, count(*) as s from grams x join grams y on x.g = y.g and x.id < y.id group by all),
pairs as (select id_a, id_b from shared join sizes p on id_a = p.id join sizes q on id_b = q.id where 2 * s >= p.n + q.n - s)"""
_BASKETS = f"""
b as (select id, lower(trim(t, {_TRIM})) as tag from (select id, unnest(tags) as t from notes where id is not null)),
items as (select distinct id, tag from b where tag <> ''),
singles as (select tag, count(*) as n from items group by tag),
pairs as (select x.tag as tag_a, y.tag as tag_b, count(*) as ab from items x join items y on x.id = y.id and x.tag < y.tag group by all),
scored as (select tag_a, tag_b, ab, p.n as count_a, q.n as count_b, (select count(distinct id) from items) as n_baskets
  from pairs join singles p on tag_a = p.tag join singles q on tag_b = q.tag)
"""

SQL = {
    "p1_found": f"with {_PAIRS} select id_a, id_b from pairs",
    "p1_groups": f"""with recursive {_PAIRS}, e as (select id_a as a, id_b as b from pairs union select id_b, id_a from pairs),
reach(node, other) as (select a, b from e union select reach.node, e.b from reach join e on e.a = reach.other),
first as (select node, min(other) as o from reach group by node), links as (select a as id, count(*) as k from e group by a)
select words.id, min(words.id) over (partition by w) as class_id, coalesce(least(words.id, o), words.id) as group_id, coalesce(k, 0)::bigint as n_links
from words left join first on first.node = words.id left join links on links.id = words.id where len(w) >= 3""",
    "p1_links": f"""with {_PAIRS}, classes as (select id, min(id) over (partition by w) as c from words where len(w) >= 3),
every as (select id_a, id_b, round(s / (p.n + q.n - s), 6) as similarity from shared join sizes p on id_a = p.id join sizes q on id_b = q.id where 2 * s >= p.n + q.n - s)
select distinct least(a.c, b.c) as class_a, greatest(a.c, b.c) as class_b, similarity from every join classes a on a.id = id_a join classes b on b.id = id_b where a.c <> b.c""",
    "p2_found": f"with {_TERMS} select field, term, mark from marked where mark is not null",
    "p2_terms": f"with {_TERMS} select * from marked",
    "p2_ngrams": f"""with recursive {_TOKENS}, line as (select field, record, pos, min(token) as token from clean where pos is not null group by all),
grams(field, record, pos, n, gram) as (select field, record, pos, 1, token from line
  union all select g.field, g.record, g.pos, g.n + 1, g.gram || ' | ' || l.token from grams g join line l on l.field = g.field and l.record = g.record and l.pos = g.pos + g.n),
every as (select field, record, n, gram from grams
  union all select c.field, c.record, 1, c.token from clean c where not exists (select 1 from line l where l.field = c.field and l.record = c.record and l.pos = c.pos and l.token = c.token))
select field, n::int as n, gram, count(*) as occurrences, count(distinct record) as n_records from every group by field, n, gram""",
    "p5_found": f"with {_BASKETS} select tag_a, tag_b from scored where ab >= 4 and ab * n_baskets >= 3 * count_a * count_b",
    "p5_pairs": f"with {_BASKETS} select *, round(ab::double * n_baskets / (count_a::double * count_b), 6) as lift from scored",
}
