"""Reference documents on disk: reading, hashing, incremental refresh and the markdown index of the notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.text import body_hook
from notegraph.operators.chunks import function_chunks, heading_chunks

# Extensions of the files a corpus takes, and of those that are cut by function.
EXTENSIONS = (
    ".md", ".txt", ".go", ".py", ".js", ".ts", ".rs", ".sh", ".rb", ".java", ".c", ".cpp", ".h", ".css", ".html", ".yaml", ".yml", ".json", ".toml", ".xml",
)
CODE_EXTENSIONS = (".go", ".py", ".js", ".ts", ".rs", ".sh", ".rb", ".java", ".c", ".cpp")
# End of fixed values.


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def chunk_strategy(path: Column) -> Column:
    """``function-level`` for source code, else ``heading-aware``."""
    return F.when(extension(path).isin(*CODE_EXTENSIONS), "function-level").otherwise("heading-aware")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, text, hash of every file of a known extension below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(extension(F.col("path")).isin(*EXTENSIONS)).select(
        "path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash")
    )


def refresh(chunks: DataFrame, manifest: DataFrame, files: DataFrame, chunker) -> DataFrame:
    """The chunks after a refresh: those of files whose hash is unchanged are kept, changed and new files are chunked again.

    ``chunks`` has path and what ``chunker`` gives for (id, text); ``manifest`` and ``files`` have path and hash. Files are
    told apart by their whole path.
    """
    same = files.join(manifest, ["path", "hash"], "left_semi").select("path")
    kept = chunks.join(same, "path", "left_semi")
    again = files.join(same, "path", "left_anti").select(F.col("path").alias("id"), "text")
    return kept.unionByName(chunker(again).withColumnRenamed("id", "path"))


def ensured(manifest: DataFrame, asked: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of the union of the manifest's paths and those asked for: ``kept`` (same hash), ``changed``, ``added`` or
    ``missing`` (no such file). ``manifest`` and ``files`` have path and hash, ``asked`` has path."""
    paths = manifest.select("path").unionByName(asked.select("path")).filter("path is not null").distinct()
    was = manifest.groupBy("path").agg(F.min("hash").alias("was"))
    now = files.groupBy("path").agg(F.min("hash").alias("now"), F.lit(True).alias("there"))
    both = paths.join(was, "path", "left").join(now, "path", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("was") == F.col("now"), "kept").when(F.col("was").isNull(), "added").otherwise("changed")
    return both.select("path", state.alias("state"))


def chunked(files: DataFrame) -> DataFrame:
    """id, idx, heading, text of files (id, path, text), each cut as its extension asks for."""
    kind = chunk_strategy(F.col("path"))
    prose = heading_chunks(files.filter(kind == "heading-aware"))
    return prose.unionByName(function_chunks(files.filter(kind == "function-level")))


def ingest(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Cut the files (corpus, path, text, hash) of corpora into chunks, write both below ``path`` and return chunks and manifest.

    Files of other extensions are left out. The manifest has corpus, path and hash of every file, also of one without chunks;
    chunks have corpus, id (corpus, path and number), source_path, heading and text.
    """
    spark = files.sparkSession
    taken = files.filter(extension(F.col("path")).isin(*EXTENSIONS))
    taken.select("corpus", "path", "hash").write.mode("overwrite").parquet(f"{path}/manifest")
    keyed = taken.withColumn("id", F.struct("corpus", "path"))
    parts = chunked(keyed.select("id", "path", "text"))
    named = parts.select("id.corpus", F.concat_ws("-", "id.corpus", "id.path", "idx").alias("id"), F.col("id.path").alias("source_path"), "heading", "text")
    save_chunks(named, f"{path}/chunks")
    return load_chunks(spark, f"{path}/chunks"), spark.read.parquet(f"{path}/manifest")


def anchors(manifest: DataFrame) -> DataFrame:
    """id, type, title, corpus: the note that stands for each corpus of a manifest."""
    return manifest.select("corpus").distinct().select(
        F.concat(F.lit("anchor-"), "corpus").alias("id"), F.lit("anchor").alias("type"), F.concat(F.lit("Reference: "), "corpus").alias("title"), "corpus"
    )


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks (corpus, id, source_path, heading, text) as a table with a folder for each corpus."""
    chunks.write.mode("overwrite").partitionBy("corpus").parquet(path)


def load_chunks(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    chunks = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("corpus", F.col("corpus").cast("string"))
    return chunks if corpus is None else chunks.filter(F.col("corpus") == corpus)


def manifest(chunks: DataFrame) -> DataFrame:
    """corpus, chunk_count, n_files, checksum: what a corpus holds; the checksum adds up a hash of each chunk, in any order."""
    part = F.conv(F.substring(F.md5(F.concat("id", F.lit("="), "text")), 1, 8), 16, 10).cast("bigint")
    return chunks.groupBy("corpus").agg(F.count("*").alias("chunk_count"), F.countDistinct("source_path").alias("n_files"), F.sum(part).alias("checksum"))


def index_line(limit: int = 200) -> Column:
    """``- [title](nodes/id.md) — hook`` of a note, cut to ``limit`` characters."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("id"))
    hook = body_hook(F.col("body"))
    line = F.concat(F.lit("- ["), title, F.lit("](nodes/"), F.col("id"), F.lit(".md)"), F.when(hook != "", F.concat(F.lit(" — "), hook)).otherwise(""))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 3)), F.lit("..."))).otherwise(line)


def write_index(notes: DataFrame, path: str) -> None:
    """One text file per type with the index lines in order of the titles."""
    lines = notes.select("type", index_line().alias("value"), F.lower(F.coalesce("title", "id")).alias("by"), "id")
    lines.repartition("type").sortWithinPartitions("type", "by", "id").select("type", "value").write.partitionBy("type").text(path)
