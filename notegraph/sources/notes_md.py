"""Notes kept as markdown files with front matter, one note per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # flat front matter is read without it
    yaml = None

_FRONT = r"(?s)\A---\r?\n?(.*?)\r?\n---[^\n]*\r?\n?(.*)\z"
# The fields of a note's front matter.
_LISTS = (
    "tags", "depends_on", "blocks", "relates_to", "builds_on", "contradicts", "supersedes", "caused_by", "informed_by", "acceptance",
)
_SCALARS = (
    "id", "type", "status", "title", "weight", "origin", "action", "created_at", "last_accessed", "access_count", "parent", "source_issue", "size", "deleted_at",
    "forwarded_to",
)
_REF = ("provider", "id", "url")
# End of fixed values.


def _bare(value: str) -> str | None:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    return None if value in ("", "null", "~") else value


def front_matter(text: str) -> dict:
    """Scalars and flat lists of the front matter; lines of any other shape are left out."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        if line.lstrip().startswith("- ") and key is not None:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), _bare(line.lstrip()[2:])]
        elif ":" in line and not line[:1].isspace():
            key, value = line.split(":", 1)
            key, value = key.strip(), value.strip()
            out[key] = [_bare(x) for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" and value[-1:] == "]" else _bare(value)
    return out


def _text(value: object) -> str | None:
    if value is None or isinstance(value, (list, dict)):
        return None
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def parsed(front: str) -> dict | None:
    """The front matter as a mapping; null if it is not one. Without the YAML library only flat fields are read."""
    if yaml is None:
        return front_matter(front)
    try:
        held = yaml.safe_load(front)
    except yaml.YAMLError:
        return None
    return held if isinstance(held, dict) else None


def _row(front: str) -> dict:
    held = parsed(front) or {}
    row: dict = {c: _text(held.get(c)) for c in _SCALARS}
    for c in _LISTS:
        row[c] = [_text(x) for x in held[c]] if isinstance(held.get(c), list) else None
    met, refs = held.get("acceptance_met"), held.get("external_refs")
    row["acceptance_met"] = [x in (True, "true") for x in met] if isinstance(met, list) else None
    row["external_refs"] = [{k: _text(x.get(k)) for k in _REF} for x in refs if isinstance(x, dict)] if isinstance(refs, list) else None
    return row


def read_notes(spark: SparkSession, *paths: str) -> DataFrame:
    """The notes of all ``*.md`` files below the paths, with ``file_path`` and ``origin_scope``, the folder above ``nodes`` or ``trash``.

    Files without front matter, with front matter that is no mapping, or without an id in it are left out. Fields of the wrong
    kind are null.
    """
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    return parse_notes(files.select("value", F.input_file_name().alias("file_path")))


def parse_notes(files: DataFrame) -> DataFrame:
    """The notes of whole files (value, file_path), as ``read_notes`` gives them."""
    split = files.select(F.regexp_extract("value", _FRONT, 1).alias("front"), F.regexp_extract("value", _FRONT, 2).alias("body"), "file_path").filter("front <> ''")
    refs = "array<struct<" + ", ".join(f"{k}: string" for k in _REF) + ">>"
    shape = ", ".join([f"{c} string" for c in _SCALARS] + [f"{c} array<string>" for c in _LISTS] + ["acceptance_met array<boolean>", f"external_refs {refs}"])
    names = [*_SCALARS, *_LISTS, "acceptance_met", "external_refs"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([_row(text) for text in batch["front"]], columns=names, dtype=object)
            rows["body"], rows["file_path"] = batch["body"].to_numpy(), batch["file_path"].to_numpy()
            yield rows

    notes = split.mapInPandas(parse, shape + ", body string, file_path string")
    kinds = (("weight", "double"), ("access_count", "int"), ("created_at", "timestamp"), ("last_accessed", "timestamp"), ("deleted_at", "timestamp"))
    typed = {c: F.expr(f"try_cast({c} as {t})") for c, t in kinds}
    return notes.withColumns(typed).withColumn("origin_scope", F.regexp_extract("file_path", r"([^/]+)/(?:nodes|trash)/[^/]*$", 1)).filter("id is not null")


def read_trash(spark: SparkSession, *paths: str) -> DataFrame:
    """The deleted notes of the ``trash`` folders below the paths."""
    return read_notes(spark, *[f"{path.rstrip('/')}/trash" for path in paths])
