"""Counts of all n-grams of token sequences from a suffix array with common-prefix intervals.

A suffix is a token with those that follow it in its record, up to ``depth`` tokens or to the end. Suffixes grow by prefix
doubling: each round appends the suffix that starts where the last one ended. Sorted, equal prefixes stand together: an
interval of suffixes that share n tokens is an n-gram, its length the number of occurrences. Within a record's own sorted
suffixes each neighbour that shares n tokens is a duplicate; an interval's length less its duplicates is the number of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.scratch import materialize

_SCHEMA = "field string, gram array<string>, occurrences bigint, n_records bigint"
#: Cells of the matrix of tokens in which common prefixes are measured at once.
_CELLS = 1 << 22


def suffixes(tokens: DataFrame, depth: int | None = None) -> DataFrame:
    """field, record, t1, suffix: the tokens from each position on, at most ``depth``; positions that differ by one are neighbours.

    Of several tokens at one position the smallest stands in the sequence, the others by themselves.
    """
    if depth == 1:
        return tokens.select("field", "record", F.col("token").alias("t1"), F.array("token").alias("suffix"))
    first = F.row_number().over(Window.partitionBy("field", "record", "pos").orderBy("token")) == 1
    line = tokens.withColumn("first", F.col("pos").isNotNull() & first)
    grown = materialize(line.filter("first").select("field", "record", "pos", F.array("token").alias("suffix")), "suffixes")
    span = 1
    while depth is None or span < depth:
        ahead = grown.filter(F.size("suffix") <= span).select("field", "record", (F.col("pos") - span).alias("pos"), F.col("suffix").alias("more"))
        whole = F.concat("suffix", F.coalesce("more", F.array().cast("array<string>")))
        step = grown.join(ahead, ["field", "record", "pos"], "left")
        full = F.size("suffix") == span  # a shorter one ends with its run of positions
        step = step.select("field", "record", "pos", F.when(full, whole if depth is None else F.slice(whole, 1, depth)).otherwise(F.col("suffix")).alias("suffix"))
        grown = materialize(step, "suffixes")
        span *= 2
        if not grown.agg(F.max(F.size("suffix") >= span)).first()[0]:
            break
    alone = line.filter("not first").select("field", "record", F.array("token").alias("suffix"))
    return grown.select("field", "record", "suffix").unionByName(alone).withColumn("t1", F.col("suffix")[0])


def _shared(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many tokens each row shares with the row before; rows are padded codes."""
    out = np.zeros(len(codes), dtype=np.int64)
    if len(codes) > 1:
        same = codes[1:] == codes[:-1]
        same &= np.arange(codes.shape[1]) < np.minimum(size[1:], size[:-1])[:, None]
        out[1:] = np.where(same.all(axis=1), codes.shape[1], np.argmin(same, axis=1))
    return out


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Common-prefix intervals of each batch of the sorted suffixes; those that a border cuts are added up afterwards."""
    for batch in batches:
        size = batch["suffix"].map(len).to_numpy() if len(batch) else np.empty(0, dtype=np.int64)
        step = max(1, _CELLS // int(size.max(initial=1)))
        for at in range(0, len(batch), step):
            part, n = batch.iloc[at : at + step], size[at : at + step]
            suffix, field = part["suffix"].to_numpy(), part["field"].to_numpy()
            c, r, own = (part[x].to_numpy() for x in ("c", "r", "own"))
            tokens, _ = pd.factorize(np.concatenate(suffix))
            codes = np.full((len(part), int(n.max())), -1, dtype=np.int64)
            codes[np.repeat(np.arange(len(part)), n), np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)] = tokens
            shared = _shared(codes, n)
            shared[1:][field[1:] != field[:-1]] = 0
            for k in range(1, codes.shape[1] + 1):
                # a shorter suffix ends every interval of k tokens; it sorts before those it is a prefix of
                long = np.flatnonzero(n >= k)
                start = np.flatnonzero(shared[long] < k)
                yield pd.DataFrame({
                    "field": field[long[start]], "gram": [suffix[i][:k] for i in long[start]],
                    "occurrences": np.add.reduceat(c[long], start), "n_records": np.add.reduceat(np.where(own[long] < k, r[long], 0), start),
                })


def ngram_counts(tokens: DataFrame, depth: int | None = None) -> DataFrame:
    """field, n, gram (array of n tokens), occurrences, n_records for every n-gram, of at most ``depth`` tokens if it is given.

    ``tokens`` has field, record, pos, token; other columns are ignored. Rows with a null or empty token or a null record do
    not count and break the sequence; repeated rows are one; a token without position has no neighbours. No rows give none.
    """
    clean = tokens.select("field", "record", "pos", "token").filter("record is not null and token <> ''")
    # the reductions and the order within a record all follow one partitioning by record and first token
    clean = clean.repartition("field", "record", "token").distinct() if depth == 1 else clean.distinct()
    own = suffixes(clean, depth).groupBy("field", "record", "t1", "suffix").agg(F.count("*").alias("c"))
    if depth == 1:
        shared = F.lit(0)  # the distinct suffixes of a record share no token
    else:
        before = F.lag("suffix").over(Window.partitionBy("field", "record", "t1").orderBy("suffix"))
        differ = F.array_position(F.zip_with("suffix", before, lambda a, b: ~a.eqNullSafe(b)), F.lit(True))
        shared = F.when(before.isNull(), 0).when(differ > 0, differ - 1).otherwise(F.size("suffix")).cast("int")
    distinct = own.withColumn("own", shared).groupBy("field", "suffix", "own").agg(F.sum("c").alias("c"), F.count("*").alias("r"))
    array = distinct.repartitionByRange("field", "suffix").sortWithinPartitions("field", "suffix")
    cut = array.mapInPandas(_intervals, _SCHEMA)
    whole = cut.groupBy("field", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))
    return whole.select("field", F.size("gram").alias("n"), "gram", "occurrences", "n_records")


def marked_terms(counts: DataFrame, tokens: DataFrame, rare_records: int = 2, common_share: float = 0.05) -> DataFrame:
    """field, term, occurrences, n_records, mark: ``rare`` with at most ``rare_records`` records, ``common`` with more than
    ``common_share`` of the field's records that have a token, else null; a term that is both is rare."""
    records = tokens.filter("record is not null and token <> ''").groupBy("field").agg(F.countDistinct("record").alias("n_all"))
    terms = counts.filter("n = 1").join(records, "field")
    mark = F.when(F.col("n_records") <= rare_records, "rare").when(F.col("n_records") > F.col("n_all") * F.lit(common_share), "common")
    return terms.select("field", F.col("gram")[0].alias("term"), "occurrences", "n_records", mark.alias("mark"))
