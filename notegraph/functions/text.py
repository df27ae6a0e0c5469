"""Text functions of notes and documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph import schema
from notegraph.sources.tables import trimmed

#: The characters with the Unicode property White_Space.
WHITE_SPACE = r"[\p{IsWhite_Space}]+"


def search_words(text: Column) -> Column:
    """Lower-case ASCII words of at least two characters, repeats kept; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9_]{2,}"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """The search words without stop words."""
    return F.filter(search_words(text), lambda w: ~w.isin(*schema.SEARCH_STOP_WORDS))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, first seen first, of at least two bytes and without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*schema.KEYWORD_STOP_WORDS)))


def fields(text: Column) -> Column:
    """The words between runs of white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    return (F.size(fields(text)) * F.lit(1.3)).cast("int")


def byte_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def wiki_links(body: Column, own: Column) -> Column:
    """Distinct targets of ``[[target]]`` other than the note itself."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(schema.WIKI_LINK), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x != own))


def visible_characters(body: Column) -> Column:
    """Number of code points other than the six ASCII white-space characters."""
    return F.length(F.regexp_replace(F.coalesce(body, F.lit("")), r"[ \t\n\r\x0B\f]", ""))


def body_hook(body: Column, limit: int = 120) -> Column:
    """First line that is neither blank nor a heading, without bullet and bold marks, cut to ``limit`` characters."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    first = F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(first, r"^[-*] ", ""), r"\*\*|__", "")
    return F.coalesce(F.when(F.length(plain) > limit, F.concat(F.left(plain, F.lit(limit - 3)), F.lit("..."))).otherwise(plain), F.lit(""))


def secrets(body: Column, patterns: tuple) -> Column:
    """Descriptions of the patterns that occur in the body, in the patterns' order."""
    text = F.coalesce(body, F.lit(""))
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(d)) for p, d in patterns]), lambda x: x.isNotNull())


def name_problem(name: Column) -> Column:
    """Why a corpus name is not usable, or null."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty")
        .when(F.octet_length(name) > 100, "too long")
        .when(name.contains(".."), "path traversal")
        .when(name.rlike(r"[/\\]"), "path separator")
        .when(name.rlike(r"[\x00\r\n\t]"), "control character")
        .when(F.upper(name).isin(*schema.RESERVED_NAMES), "reserved")
        .when(~name.rlike(schema.NAME_PATTERN), "invalid character")
    )


def tag_problem(tag: Column) -> Column:
    return (
        F.when(F.coalesce(tag, F.lit("")) == "", "empty")
        .when(F.octet_length(tag) > 100, "too long")
        .when(~tag.rlike(schema.NAME_PATTERN), "invalid character")
    )


def checklist(body: Column) -> Column:
    """Structs (done, item) of the ``- [ ] item`` lines."""
    pattern = r"(?m)^- \[([ xX])\] (.+)$"
    text = F.coalesce(body, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(marks, items, lambda m, i: F.struct((F.lower(m) == "x").alias("done"), i.alias("item")))


def scope_of(note_id: Column) -> Column:
    """The project prefix of an id: what stands before the first hyphen, if anything does."""
    return F.when(F.instr(note_id, "-") > 1, F.substring_index(note_id, "-", 1)).otherwise(F.lit(""))


def clean_list(items: Column) -> Column:
    """Trimmed entries without nulls and blanks, order and repeats kept; null gives none."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), trimmed), lambda x: x != "")


def path_keywords(paths: Column) -> Column:
    """The distinct keywords of all paths of an array, first seen first."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(paths, F.array().cast("array<string>")), keywords)))


def file_keywords(paths: Column) -> Column:
    """Lower-case parts of paths without extension and longer than two bytes, distinct and sorted."""
    parts = F.flatten(F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.split(p, "/")))
    names = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"\.[^.]*$", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.octet_length(n) > 2)))


def matched_tags(topic: Column, tags: Column) -> Column:
    """For each keyword of the topic the first tag that equals it, whatever its case."""
    hits = F.transform(keywords(topic), lambda k: F.get(F.filter(tags, lambda t: F.lower(t) == k), F.lit(0)))
    return F.filter(hits, lambda x: x.isNotNull())


def title_of(text: Column) -> Column:
    """What stands before the first line end of the trimmed text, trimmed; the whole text if there is none."""
    return trimmed(F.substring_index(trimmed(text), "\n", 1))


def body_of(text: Column) -> Column:
    """What stands after the first line end of the trimmed text, trimmed; empty if there is none."""
    whole = trimmed(text)
    at = F.instr(whole, "\n")
    return F.when(at > 0, trimmed(F.substring(whole, at + 1, F.length(whole)))).otherwise(F.when(text.isNotNull(), F.lit("")))


def external_ref(text: Column) -> Column:
    """Struct (provider, id, url) of ``provider:id`` or ``provider:id:url``; null without an id. The url may hold colons."""
    parts = F.split(text, ":", 3)
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("provider"), F.get(parts, F.lit(1)).alias("id"), F.get(parts, F.lit(2)).alias("url")))
