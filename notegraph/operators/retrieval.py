"""BM25 over any (id, text): postings, search of many queries at once, distinctive terms, similar texts, seeds.

Term frequency is divided by the length of the text before the BM25 formula, as the scores to match require.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph import schema
from notegraph.functions import text as tx
from notegraph.operators import products
from notegraph.schema import BM25_B, BM25_K1
from notegraph.scratch import exists, held, materialize, write
from notegraph.sources.tables import spread


@dataclass(frozen=True)
class Index:
    """postings (id, term, tf, doc_len), terms (term, df, idf) and two numbers of the collection; lists are the postings by text
    (id, doc_len, counts of term and n) where they are at hand."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avg_len: float
    lists: DataFrame | None = None


#: What a byte of a text becomes in a search word; 0 where none goes on.
_LETTERS = np.zeros(256, dtype=np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz0123456789_":
    _LETTERS[[ord(_c), ord(_c.upper())]] = ord(_c)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text of each search word, and the words, as ``tx.search_words`` finds them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for upper, lower in (("\u0130", "i\u0307"), ("\u212a", "k")):  # the others whose lower case has ASCII letters
        texts = pc.replace_substring(texts, upper, lower)
    _, upto, data = texts.buffers()
    upto = np.frombuffer(upto, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = _LETTERS[np.frombuffer(data, dtype=np.uint8)[upto[0] : upto[-1]]] if data is not None else _LETTERS[:0]
    upto = upto - upto[0]
    inside = letters != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = upto[:-1][upto[1:] > upto[:-1]], upto[1:][upto[1:] > upto[:-1]] - 1
    begins[first], ends[last] = inside[first], inside[last]
    at = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - at
    inside[at[length < 2]] = False
    at, length = at[length >= 2], length[length >= 2]
    bounds = np.r_[0, np.cumsum(length)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(letters[inside]))
    return np.searchsorted(upto, at, side="right") - 1, words


def _counted(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(schema.SEARCH_STOP_WORDS)
        for batch in batches:
            row, words = _words(batch["text"])
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            kept = ~pc.is_in(coded.dictionary, value_set=stop).to_numpy(zero_copy_only=False)[code]
            row, code = row[kept], code[kept]
            cells, n = np.unique(row * len(coded.dictionary) + code, return_counts=True)
            at, term = np.divmod(cells, max(len(coded.dictionary), 1))
            length = np.bincount(row, minlength=len(batch))
            some = np.flatnonzero(length)
            upto = np.r_[0, np.cumsum(np.bincount(at, minlength=len(batch))[some])].astype(np.int32)
            counts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(term)), pa.array(n.astype(np.int32))], ["term", "n"])
            columns = {"doc_len": pa.array(length[some].astype(np.int32)), "counts": pa.ListArray.from_arrays(pa.array(upto), counts)}
            columns |= {x: batch[x].take(pa.array(some)) for x in names if x not in columns}
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return run


def _lists(docs: DataFrame, *by: str) -> DataFrame:
    """Each text's terms with the number of times it has them; a text is tokenized once and nothing is shuffled."""
    names = [*by, "id", "doc_len", "counts"]
    kinds = {x: docs.schema[x].dataType for x in (*by, "id")} | {"doc_len": T.IntegerType(), "counts": T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())]))}
    texts = spread(docs.select(*by, "id", "text"))
    return texts.mapInArrow(_counted(names), T.StructType([T.StructField(x, kinds[x]) for x in names]))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of a file with the number of texts that have them and of times that they stand there."""
    held, rows = [], 0
    for batch in batches:
        held.append(_tally(pa.table({"term": _values(batch["counts"], "term"), "n": _values(batch["counts"], "n")}), "count"))
        rows += len(held[-1])
        if rows > products._HELD:
            held = [_tally(pa.concat_tables(held), "sum")]
            yield from held[0].to_batches()
            held, rows = [], 0
    if held:
        yield from _tally(pa.concat_tables(held), "sum").to_batches()


def _tally(rows: pa.Table, df: str) -> pa.Table:
    if df == "count":
        rows = rows.append_column("df", pa.array(np.ones(len(rows), dtype=np.int64)))
    sums = rows.group_by("term").aggregate([("df", "sum"), ("n", "sum")])
    return pa.table({x: sums[c].cast(k) for x, c, k in (("term", "term", pa.string()), ("df", "df_sum", pa.int64()), ("n", "n_sum", pa.int64()))})


def _values(lists: pa.Array, name: str) -> pa.Array:
    """A field of the items of lists of structs."""
    return lists.flatten().field(name)


def _posted(lists: DataFrame, *by: str) -> DataFrame:
    """Postings of lists."""
    rows = lists.select(*by, "id", "doc_len", F.inline("counts"))
    return rows.select(*by, "id", "term", (F.col("n").cast("double") / F.col("doc_len")).alias("tf"), "doc_len", "n")


def _idf(n_docs: Column) -> Column:
    return F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)


def build_index(docs: DataFrame) -> Index:
    """Index of (id, text). Texts without tokens count in the number and mean length of the texts and have no postings."""
    lists = materialize(_lists(docs), "postings")
    postings = _posted(lists)
    n_docs = docs.count()
    tallies = products.mapped(products.Files(lists, ("counts",), lambda batch: batch), _tallied, {"term": T.StringType(), "df": T.LongType(), "n": T.LongType()})
    df = tallies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    terms = materialize(df.withColumn("idf", _idf(F.lit(float(n_docs)))), "terms")
    total = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Index(postings.drop("n"), terms.drop("n"), n_docs, total / n_docs if n_docs else 0.0, lists)


def save_index(index: Index, path: str) -> None:
    """Write the index as tables; postings by ranges of terms, so that a search reads those of its terms."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    spark = index.postings.sparkSession
    spark.createDataFrame([(index.n_docs, index.avg_len)], "n_docs bigint, avg_len double").coalesce(1).write.mode("overwrite").parquet(f"{path}/collection")


def load_index(spark: SparkSession, path: str) -> Index:
    n_docs, avg_len = spark.read.parquet(f"{path}/collection").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n_docs, avg_len)


_kept: dict[str, Index] = {}


def kept_index(docs: DataFrame, name: str, version: str) -> Index:
    """The index of ``docs`` that this application keeps under ``name``; built when there is none, or when ``version`` of the data
    has changed since, or when its tables were released."""
    spark = docs.sparkSession
    key = f"{spark.sparkContext.applicationId}/{name}/{version}"
    index = _kept.get(key)
    if index is None or not all(exists(spark, file) for part in (index.postings, index.terms) for file in part.inputFiles()[:1]):
        with held():
            index = _kept[key] = build_index(docs)
    return index


def _weight(index: Index) -> Column:
    return _term_weight(F.lit(index.avg_len or 1.0))


def _term_weight(avg_len: Column) -> Column:
    norm = F.lit(BM25_K1) * (1 - BM25_B + F.lit(BM25_B) * F.col("doc_len") / avg_len)
    return F.col("idf") * (F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm))


def _saturated(tf: Column, avg_len: Column) -> Column:
    """What a term adds to a score besides its own value."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + F.lit(BM25_B) * F.col("doc_len") / avg_len))


def _saturated_counts(n: np.ndarray, doc_len: np.ndarray, avg_len: np.ndarray) -> np.ndarray:
    """The same of arrays, for a term that stands n times."""
    tf = n / doc_len
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / avg_len))


def _by_text(index: Index) -> DataFrame:
    """id, doc_len, counts (term, tf) of the texts of an index that has no lists."""
    rows = index.postings.groupBy("id").agg(F.any_value("doc_len").alias("doc_len"), F.collect_list(F.struct("term", "tf")).alias("counts"))
    return materialize(rows, "by-text")


def _listed(lists: DataFrame, avg_len: float) -> products.Files:
    """Lists of terms and counts as the workers read them."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = batch["counts"]
        upto = pa.array(np.r_[0, np.cumsum(pc.list_value_length(counts).to_numpy(zero_copy_only=False))].astype(np.int32))
        terms, n = (pa.ListArray.from_arrays(upto, _values(counts, x)) for x in ("term", "n"))
        columns = [batch["id"], terms, n, batch["doc_len"].cast(pa.float64()), pa.array(np.full(len(batch), avg_len))]
        return pa.RecordBatch.from_arrays(columns, ["id", "terms", "weights", "doc_len", "avg_len"])

    return products.Files(lists, ("id", "doc_len", "counts"), made)


def _corpus_lists(corpora: Corpora) -> products.Files:
    """The same of corpora: the name of a corpus stands in front of its terms, and the workers read its mean length."""
    folder = corpora.sizes.inputFiles()[0].rsplit("/", 1)[0]
    sizes: list[pa.Table] = []

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not sizes:
            sizes.append(pa.Table.from_batches(list(products.tables(folder, ["corpus", "avg_len"], 1 << 16))).combine_chunks())
        corpus, counts = batch["corpus"], batch["counts"]
        n = pc.list_value_length(counts).to_numpy(zero_copy_only=False)
        upto = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        front = pc.binary_join_element_wise(pc.utf8_length(corpus).cast(pa.string()), corpus, "", ":").take(pa.array(np.repeat(np.arange(len(batch)), n)))
        terms = pc.binary_join_element_wise(front, _values(counts, "term"), "")
        avg_len = products._whole(sizes[0]["avg_len"]).take(pc.index_in(corpus, value_set=products._whole(sizes[0]["corpus"])))
        columns = [corpus, batch["id"], pa.ListArray.from_arrays(upto, terms), pa.ListArray.from_arrays(upto, _values(counts, "n")), batch["doc_len"].cast(pa.float64()), avg_len]
        return pa.RecordBatch.from_arrays(columns, ["part", "id", "terms", "weights", "doc_len", "avg_len"])

    return products.Files(corpora.lists, ("corpus", "id", "doc_len", "counts"), made, "corpus")


def _weighed(index: Index) -> DataFrame | products.Files:
    """id, terms, weights: texts for products with what is asked, whose terms bring their own value."""
    if index.lists is not None:
        return _listed(index.lists, index.avg_len or 1.0)
    weight = F.transform("counts", lambda c: _saturated(c["tf"], F.lit(index.avg_len or 1.0)))
    return _by_text(index).select("id", F.col("counts.term").alias("terms"), weight.alias("weights"))


def _asked(queries: DataFrame) -> DataFrame:
    words = queries.select("query_id", F.explode(tx.search_words(F.col("text"))).alias("term")).filter(~F.col("term").isin(*schema.SEARCH_STOP_WORDS))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank of the k best texts of each query (query_id, text); a repeated query term counts each time."""
    asked = _asked(queries).join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    return products.best(products.matches(_weighed(index), asked, k, weigh=_saturated_counts), ["query_id"], k)


@dataclass(frozen=True)
class Corpora:
    """Indexes of many corpora side by side, each with its own frequencies: postings, terms, sizes and lists have the corpus."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    lists: DataFrame


def build_corpora(chunks: DataFrame) -> Corpora:
    """Indexes of chunks (corpus, id, text)."""
    lists = materialize(_lists(chunks, "corpus"), "corpus-postings")
    postings = _posted(lists, "corpus")
    total = postings.groupBy("corpus").agg(F.sum("n").alias("total"))
    sizes = chunks.groupBy("corpus").agg(F.count("*").alias("n_docs")).join(total, "corpus", "left")
    sizes = materialize(sizes.select("corpus", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_len")), "corpus-sizes")
    df = postings.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(sizes, "corpus")
    return Corpora(postings, materialize(df.select("corpus", "term", _idf(F.col("n_docs").cast("double")).alias("idf"), "avg_len"), "corpus-terms"), sizes, lists)


def search_corpora(corpora: Corpora, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """query_id, corpus, id, score, rank of the k best chunks of each corpus for each query (query_id, text, and corpus if only
    one is asked); with ``within`` (query_id, corpus) only of those corpora for a query."""
    asked = _asked(queries)
    if within is not None:
        asked = asked.join(within.select("query_id", "corpus").distinct(), "query_id").join(corpora.terms, ["corpus", "term"])
    elif "corpus" in queries.columns:
        asked = asked.join(queries.select("query_id", "corpus").distinct(), "query_id").join(corpora.terms, ["corpus", "term"])
    else:
        asked = asked.join(corpora.terms, "term")
    # a corpus asks with its own terms, so one list of terms holds what is asked of all of them
    asked = asked.select("query_id", F.concat(_length("corpus"), "term").alias("term"), (F.col("times") * F.col("idf")).alias("weight"))
    parts = 1 if "corpus" in queries.columns else corpora.sizes.count()
    found = products.matches(_corpus_lists(corpora), asked, k, weigh=_saturated_counts, parts=parts).withColumnRenamed("part", "corpus")
    return products.best(found, ["query_id", "corpus"], k)


def _length(name: str) -> Column:
    """The name and where it ends, in front of a term."""
    return F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name), F.lit(":"))


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of all corpora for each query, scores of different corpora side by side as they are."""
    return products.best(found.drop("rank"), ["query_id"], k)


def _share(count: np.ndarray, doc_len: np.ndarray, _: np.ndarray) -> np.ndarray:
    return count / doc_len


def distinctive_terms(index: Index, n: int = 8, lists: bool = False) -> DataFrame:
    """id, term, weight, rank: the n terms of each text with the largest tf x idf; ``lists`` as in ``products.leading``."""
    if index.lists is not None:
        return products.leading(_listed(index.lists, 1.0), index.terms, n, _share, lists)
    texts = _by_text(index).select("id", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("weights"))
    return products.leading(texts, index.terms, n, lists=lists)


def similar(index: Index, k: int = 3, min_score: float = 1.0, terms: int = 8) -> DataFrame:
    """src, id, score, rank: for each text the k others that score best for its distinctive terms."""
    found = products.matches(_weighed(index), distinctive_terms(index, terms, lists=True), k, min_score, others=True, weigh=_saturated_counts)
    return products.best(found, ["query_id"], k).withColumnRenamed("query_id", "src")


def thresholds(n_docs: int) -> tuple[float, float]:
    """Least scores for prompt context and for content similarity, scaled with the size of the collection."""

    def rarest(n: int) -> float:
        return log((n - 0.5) / 1.5 + 1) if n > 0 else 0.0

    if n_docs <= 0:
        return 0.3, 0.15
    ratio = rarest(n_docs) / rarest(50)
    return min(max(2.0 * ratio, 0.3), 6.0), min(max(1.0 * ratio, 0.15), 3.0)


#: Titles held at once by a task, words looked for at once, letters of a word by which it is found.
_TITLES, _WORDS, _START = 1 << 16, 1 << 18, 4


def _holding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def searched(ids: pa.Array, titles: list[str], words: list[str]) -> pa.RecordBatch:
        starts: dict[str, dict[int, set[str]]] = {}
        for word in words:
            starts.setdefault(word[:_START], {}).setdefault(len(word), set()).add(word)
        shorter = sorted({len(x) for x in starts} - {_START})
        kept, found = [], []
        for at, title in enumerate(titles):
            held = set()
            for i in range(len(title)):
                for n in (_START, *shorter):
                    for length, some in starts.get(title[i : i + n], {}).items():
                        if (word := title[i : i + length]) in some:
                            held.add(word)
            if held:
                kept.append(at)
                found.append(sorted(held))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(found, pa.list_(pa.string()))], ["id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _TITLES):
                part = batch.slice(at, _TITLES)
                for words in products.tables(path, ["word"], _WORDS):
                    yield searched(part["id"], part["title"].to_pylist(), words["word"].to_pylist())

    return run


def titles_with(words: DataFrame, titles: DataFrame) -> DataFrame:
    """id, words: of each title (id, title) the words (word) that it contains, if there are any; of many words in several rows.

    A task looks at its titles letter by letter for the words, which it reads from the scratch folder: nothing is shuffled.
    """
    path = write(words.select("word").filter("word <> ''").distinct().coalesce(1), "words")
    rows = spread(titles.filter("title <> ''").select("id", "title"))
    return rows.mapInArrow(_holding(path), T.StructType([T.StructField("id", titles.schema["id"].dataType), T.StructField("words", T.ArrayType(T.StringType()))]))


def contained(words: DataFrame, titles: DataFrame) -> DataFrame:
    """The rows of words (word and other columns) with the id of each title (id, title) that contains the word."""
    return words.join(titles_with(words, titles).select("id", F.explode("words").alias("word")), "word").select(*words.columns, "id")


def seeds(
    topics: DataFrame, notes: DataFrame, concepts: DataFrame, k: int = 10, index: Index | None = None, ambient: DataFrame | None = None, co_access: DataFrame | None = None
) -> DataFrame:
    """query_id, id, strength, seed_pos: the notes to start from for each topic (query_id, text).

    Per topic keyword: 1 for a concept reference (``concepts``: source, target), 1 for a tag, 0.3 for a body word; 0.5 for a
    keyword inside a title, only for topics without concept and tag hits. With an ``index`` of the notes its 20 best for a topic
    with keywords add half their score over the topic's best score. ``ambient`` (query_id, text, boost) gives further texts whose
    keywords count ``boost`` for each tag they name. ``co_access`` (name, trigger, boosted, boost; two arrays of lower-case tags)
    raises the notes with a boosted tag by ``boost`` for each such tag, in topics where a note found so far has a trigger tag.

    Topics and notes are never joined: each side is a list of weighted terms, a letter in front of a term says what it is.
    """

    def asks(rows: DataFrame, kind: str, weight: Column, name: str | Column = "word") -> DataFrame:
        return rows.select("query_id", F.concat(F.lit(kind), F.col(name) if isinstance(name, str) else name).alias("term"), weight.cast("double").alias("weight"))

    def have(rows: DataFrame, kind: str, weight: Column) -> DataFrame:
        return rows.groupBy("id").agg(F.collect_list(F.concat(F.lit(kind), "word")).alias("terms"), F.collect_list(weight.cast("double")).alias("weights"))

    one = F.lit(1.0)
    asked = materialize(topics.select("query_id", F.explode(tx.keywords(F.col("text"))).alias("word")), "asked-words")
    refs = concepts.select(F.col("source").alias("id"), F.col("target").alias("word")).filter("word is not null")
    tags = F.array_distinct(F.transform("tags", F.lower))
    # a column of its own, so that a body is cut into words once
    said = notes.select("id", "tags", tx.keywords(F.col("body")).alias("words"))
    terms, weights = [_named("w", tags), _named("w", F.col("words"))], [F.transform(tags, lambda _: one), F.array_repeat(F.lit(0.3), F.size("words"))]
    if ambient is not None:
        terms, weights = [*terms, _named("a", tags)], [*weights, F.transform(tags, lambda _: one)]
    if co_access is not None:  # each tag of a note counts, also one that only differs in case from another
        every = F.transform("tags", F.lower)
        terms, weights = [*terms, _named("c", every)], [*weights, F.transform(every, lambda _: one)]
    own = said.select("id", _joined(terms), _joined(weights, "weights"))
    parts = [have(refs, "w", one)]
    questions = [asks(asked, "w", one)]
    strong = refs.select("word").union(notes.select(F.explode(tags))).distinct()
    weak_topics = asked.join(asked.join(strong, "word", "left_semi").select("query_id").distinct(), "query_id", "left_anti")
    titles = notes.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    named = titles_with(weak_topics, titles)
    parts.append(named.select("id", _named("t", F.col("words")).alias("terms"), F.transform("words", lambda _: F.lit(0.5)).alias("weights")))
    questions.append(asks(weak_topics, "t", one))
    if index is not None:
        found = search(index, topics.join(asked.select("query_id").distinct(), "query_id", "left_semi"), 20)
        share = F.col("score") / F.max("score").over(Window.partitionBy("query_id")) * 0.5
        found = materialize(found.select("query_id", "id", F.col("query_id").cast("string").alias("word"), share.alias("s")), "searched")
        parts.append(have(found, "q", F.col("s")))
        questions.append(asks(found.select("query_id", "word").distinct(), "q", one))
    if ambient is not None:
        around = ambient.select("query_id", F.col("boost").cast("double").alias("s"), F.explode(tx.keywords(F.col("text"))).alias("word"))
        questions.append(asks(around, "a", F.col("s")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # what else speaks for a note comes to where its own terms are, which are many more
    rows = rows.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("more"), F.flatten(F.collect_list("weights")).alias("by")).join(own, "id", "full")
    signals = products.stored(rows.select("id", _joined([F.col("terms"), F.col("more")]), _joined([F.col("weights"), F.col("by")], "weights")), "signals")
    rows = signals.table
    every = questions[0]
    for more in questions[1:]:
        every = every.unionByName(more)
    if co_access is not None:
        # a topic is raised when it asks for a term of a note with a trigger tag
        marks = co_access.select("name", F.explode("trigger").alias("mark"))
        held = notes.select("id", F.explode(F.transform("tags", F.lower)).alias("mark")).join(marks, "mark").select("id", "name").distinct()
        led = rows.join(held, "id").select("name", F.explode("terms").alias("term")).distinct()
        raised = every.join(led, "term").select("query_id", "name").distinct()
        raised = raised.join(co_access.select("name", F.col("boost").alias("s"), F.explode(F.array_distinct("boosted")).alias("word")), "name")
        every = every.unionByName(asks(raised, "c", F.col("s")))
    totals = every.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    found = products.matches(signals, totals, k).withColumnRenamed("score", "strength")
    return _placed(found, k)


def _named(kind: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(kind), w))


def _joined(lists: list[Column], name: str = "terms") -> Column:
    return F.concat(*[F.coalesce(x, F.array().cast("array<string>" if name == "terms" else "array<double>")) for x in lists]).alias(name)


def _placed(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("strength", 9)), "id"))
    return scored.withColumn("seed_pos", place).filter(F.col("seed_pos") <= k)


def reranked(context: DataFrame, notes: DataFrame) -> DataFrame:
    """A context (query_id, id, hop, score) with completed tasks at half and deprecated notes at a tenth of their score, ranked again."""
    known = context.join(notes.select("id", "type", "status"), "id")
    done = F.when((F.col("type") == "task") & (F.col("status") == "completed"), 0.5).otherwise(1.0)
    old = F.when(F.col("status") == "deprecated", 0.1).otherwise(1.0)
    lower = known.select("query_id", "id", "hop", (F.col("score") * done * old).alias("score"))
    return lower.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))


def echoes(context: DataFrame, alike: DataFrame, live: DataFrame, boost: float = 0.15) -> DataFrame:
    """query_id, id, score: live notes (id) similar (src, id) to one of the context (query_id, id) that are not in it, once each."""
    near = context.select("query_id", F.col("id").alias("src")).join(alike.select("src", "id"), "src").select("query_id", "id").distinct()
    fresh = near.join(context.select("query_id", "id"), ["query_id", "id"], "left_anti").join(live.select("id"), "id", "left_semi")
    return fresh.select("query_id", "id", F.lit(boost).alias("score"))


def prompt_context(index: Index, prompts: DataFrame, notes: DataFrame, threshold: float, most: int = 3) -> DataFrame:
    """query_id, id, score, place: for prompts (query_id, text) with at least three keywords up to ``most`` active notes out of
    the five best that score ``threshold`` or more."""
    asked = prompts.select("query_id", tx.keywords(F.col("text")).alias("words")).filter(F.size("words") >= 3)
    found = search(index, asked.select("query_id", F.array_join("words", " ").alias("text")), 5).filter(F.col("score") >= threshold)
    kept = found.join(notes.filter("status = 'active'").select("id"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "id", "score", "place")


def auto_links(index: Index, fresh: DataFrame, most: int = 5, least: float = 0.1) -> DataFrame:
    """id, other, score, place: up to ``most`` notes that a new note (id, text) should point to, itself left out."""
    found = search(index, fresh.select(F.col("id").alias("query_id"), "text"), most + 1).filter((F.col("query_id") != F.col("id")) & (F.col("score") >= least))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score", "place")


def hinted(topics: DataFrame, anchors: DataFrame, least: int = 2) -> DataFrame:
    """query_id, id, n: anchors (id, hint) whose hint shares at least ``least`` keywords with the topic (query_id, text)."""
    asked = topics.select("query_id", F.explode(tx.keywords(F.col("text"))).alias("word"))
    hints = anchors.select("id", F.explode(tx.keywords(F.col("hint"))).alias("word"))
    return asked.join(hints, "word").groupBy("query_id", "id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def augmented(context: DataFrame, anchors: DataFrame, corpora: Corpora, topics: DataFrame, most: int = 2, chunks: int = 3, least: float = 0.3) -> DataFrame:
    """query_id, corpus, id, score, rank: chunks of the first ``most`` corpora that anchors (id, corpus) in the context (query_id,
    id, rank) point to and that have a chunk relevant enough."""
    places = materialize(context.join(anchors, "id").groupBy("query_id", "corpus").agg(F.min("rank").alias("at")), "places")
    found = search_corpora(corpora, topics, chunks, places).filter(F.col("score") >= least).join(places, ["query_id", "corpus"])
    order = F.dense_rank().over(Window.partitionBy("query_id").orderBy("at", "corpus"))
    return found.withColumn("_place", order).filter(F.col("_place") <= most).select("query_id", "corpus", "id", "score", "rank")


def corpus_of(chunk_ids: DataFrame, corpora: DataFrame) -> DataFrame:
    """id, corpus: the longest known name (corpus) that the id starts with before a ``-``, else the id without its last two parts.

    Names and ids meet on the prefixes of the id that end at a ``-``.
    """
    parts = F.split("id", "-")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")))
    rows = chunk_ids.select("id").distinct()
    met = rows.select("id", F.explode(prefixes).alias("corpus")).join(corpora.select("corpus").distinct(), "corpus")
    best = met.groupBy("id").agg(F.max_by("corpus", F.length("corpus")).alias("corpus"))
    plain = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "-")).otherwise(F.col("id"))
    return rows.join(best, "id", "left").select("id", F.coalesce("corpus", plain).alias("corpus"))


def threshold_columns(n_docs: Column) -> tuple[Column, Column]:
    """``thresholds`` as columns over a number of texts."""
    ratio = F.log((n_docs - 0.5) / 1.5 + 1) / F.lit(log((50 - 0.5) / 1.5 + 1))
    both = ((2.0, 0.3, 6.0), (1.0, 0.15, 3.0))
    return tuple(F.when(n_docs > 0, F.least(F.greatest(ratio * base, F.lit(low)), F.lit(high))).otherwise(F.lit(low)) for base, low, high in both)
