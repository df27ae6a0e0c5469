"""Splitting of texts into chunks for search: word windows, sections by heading, and functions of source code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as tx
from notegraph.schema import CHUNKING, FUNCTION_STARTS, Chunking

_STRIP = " \t\r\n\x0b\x0c"


def windows(words: Column, cfg: Chunking = CHUNKING) -> Column:
    """Array of texts: windows of ``cfg.window`` words, each ``cfg.step`` after the last; without overlap only the first."""
    n = F.size(words)
    last = n - 1 if cfg.step < cfg.window else F.lit(0)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(cfg.step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, cfg.window), " "))


def _chunks(parts: DataFrame) -> DataFrame:
    """Number the chunk lists of a text's parts (id, parts: array of (heading, texts)) through."""
    flat = F.flatten(F.transform("parts", lambda p: F.transform(p["texts"], lambda t: F.struct(p["heading"].alias("heading"), t.alias("text")))))
    return parts.select("id", F.posexplode(flat).alias("idx", "chunk")).select("id", "idx", "chunk.heading", "chunk.text")


def sliding_chunks(docs: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """id, idx, text of (id, text); blank and null texts give none."""
    return docs.select("id", F.posexplode(windows(tx.fields(F.col("text")), cfg)).alias("idx", "text"))


def heading_chunks(docs: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """id, idx, heading, text: a section for every line that starts with ``#``; sections that are too long become windows."""
    sections = F.split(F.coalesce("text", F.lit("")), r"\n(?=#)")

    def part(section: Column) -> Column:
        whole = F.btrim(section, F.lit(_STRIP))
        heading = F.btrim(F.regexp_extract(section, r"^#+([^\n]*)", 1), F.lit(_STRIP))
        texts = F.when(whole == "", F.array().cast("array<string>")).when(
            tx.estimated_tokens(whole) > cfg.max_tokens, windows(tx.fields(whole), cfg)
        ).otherwise(F.array(whole))
        return F.struct(heading.alias("heading"), texts.alias("texts"))

    return _chunks(docs.select("id", F.transform(sections, part).alias("parts")))


def function_chunks(docs: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """id, idx, heading, text: what stands before the first function or class, then each of them; without any, windows."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.split(text, rf"\n(?={FUNCTION_STARTS})")

    def part(piece: Column) -> Column:
        whole = F.btrim(piece, F.lit(_STRIP))
        heading = F.when(piece.rlike(rf"\A(?:{FUNCTION_STARTS})"), F.btrim(F.substring_index(piece, "\n", 1), F.lit(_STRIP))).otherwise("")
        return F.struct(heading.alias("heading"), F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole)).alias("texts"))

    starts = text.rlike(rf"(?:\A|\n)(?:{FUNCTION_STARTS})")
    plain = F.array(F.struct(F.lit("").alias("heading"), windows(tx.fields(text), cfg).alias("texts")))
    return _chunks(docs.select("id", F.when(starts, F.transform(pieces, part)).otherwise(plain).alias("parts")))


def sections(docs: DataFrame) -> DataFrame:
    """id, idx, level, heading, body of (id, text): the sections under headings of one to four ``#`` whose body is not blank."""
    text = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    pieces = docs.select("id", F.posexplode(F.split(text, r"\n(?=#{1,4}[ \t]+\S)")).alias("idx", "piece")).filter("idx > 0")
    line = F.substring_index("piece", "\n", 1)
    body = F.btrim(F.substring("piece", F.length(line) + 2, F.length("piece")), F.lit(" \t\r\n"))
    head = F.btrim(F.regexp_extract(line, r"^#+(.*)$", 1), F.lit(" \t\r\n"))
    return pieces.select("id", "idx", F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("level"), head.alias("heading"), body.alias("body")).filter("body <> ''")
