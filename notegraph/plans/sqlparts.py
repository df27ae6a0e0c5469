"""Fragments shared by the reference SQL."""

from __future__ import annotations

from notegraph import schema

#: Every query that needs a clock takes this one.
AS_OF = "2017-03-15 00:00:00"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_LISTS = ("tags", *schema.LINK_TYPES, "acceptance")


def clean(name: str) -> str:
    return f"list_filter(list_transform(coalesce({name}, []), lambda v: trim(v, {BLANK})), lambda v: v <> '')"


NOTES = f"""n as (select distinct on (id) id, type, status, title, weight, origin, created_at, last_accessed,
  coalesce(access_count, 0) as access_count, coalesce(body, '') as body, nullif(trim(parent, {BLANK}), '') as parent,
  nullif(trim(source_issue, {BLANK}), '') as source_issue, size, acceptance_met,
  {', '.join(f'{clean(x)} as {x}' for x in _LISTS)} from notes where id is not null order by id)"""

LINKS = "links as (" + " union all ".join(f"select id, '{t}' as link_type, unnest({t}) as target, generate_subscripts({t}, 1) as pos from n" for t in schema.LINK_TYPES) + ")"


def words(items: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-Z0-9_]+'), lambda w: length(w) >= 2 and w not in ({words(schema.SEARCH_STOP_WORDS)}))"


def keyword_list(text: str) -> str:
    """Distinct keywords; the order is lost."""
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 2 and w not in ({words(schema.KEYWORD_STOP_WORDS)})))"


SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def fields(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACES}'), lambda w: w <> '')"


def days(moment: str) -> str:
    return f"trunc((epoch(timestamp '{AS_OF}') - floor(epoch({moment}))) / 86400)::bigint"


def recency(moment: str) -> str:
    tiers = " ".join(f"when {days(moment)} < {limit} then {value}" for limit, value in schema.RECENCY_TIERS)
    return f"(case {tiers} else {schema.OLDEST_RECENCY} end)::double"


def lookup(value: str, table: dict[str, float]) -> str:
    return f"(case {value} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 0.0 end)::double"


def relevance(edge: str, matched: str, disputes: str) -> str:
    cfg = schema.SCORING
    return (
        f"((coalesce(weight, 0.0) + {lookup(edge, cfg.edge_bonuses)} + {lookup('status', cfg.status_penalties)}"
        f" + least(access_count * {cfg.per_access}::double, {cfg.max_access_bonus}::double) + {lookup('origin', cfg.salience)}"
        f" + (case when type = 'explore' then {cfg.explore_bonus} else 0.0 end)::double + {matched} * {cfg.tag_weight}::double"
        f" + {disputes} * ({cfg.contradiction_penalty})::double) * {recency('last_accessed')})"
    )


def bm25(docs: str) -> str:
    """CTEs over ``docs`` (id, text): postings p, terms t, stats s."""
    return f"""
d as (select id, {tokens('text')} as toks from ({docs})),
s as (select count(*)::double as n_docs, sum(len(toks))::double / count(*) as avg_len from d),
p as (select id, term, count(*)::double / any_value(n) as tf, any_value(n) as doc_len
  from (select id, len(toks) as n, unnest(toks) as term from d) group by id, term),
t as (select term, count(*) as df, ln(((select n_docs from s) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) as idf from p group by term)"""


WEIGHT = "t.idf * (p.tf * (1.2::double + 1) / (p.tf + 1.2::double * (1 - 0.75::double + 0.75::double * p.doc_len / (select avg_len from s))))"
