"""Items that appear together: pair counts by heavy-light decomposition, and how far they exceed chance.

Items that hold at least 1/``MAX_HEAVY`` of all occurrences are heavy, so there are at most ``MAX_HEAVY`` of them. Each task
counts heavy pairs as popcounts over a bit matrix of its baskets, pairs of a heavy and a light item by probing the matrix
with the light item's list of baskets, and light pairs by hashing; only its counts are shuffled. A basket longer than a block
is several lists, and every two of them meet in the same way, one list on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.scratch import materialize
from notegraph.sources.tables import folded

MAX_HEAVY = 512
#: Items of a basket that are handled together; a longer basket is several such blocks, and pairs of blocks.
BLOCK = 1024
_STEP = 1 << 21
_SCHEMA = "a string, b string, n bigint"


def _pieces(size: int):
    """Of rows (key, item), sorted and distinct, the items of each key in lists of at most ``size``; none spans two tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        part, at = TaskContext.get().partitionId(), 0

        def cut(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            nonlocal at
            code = rows.column("key").combine_chunks().dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            number = code.indices.to_numpy()
            new = np.concatenate([[True], number[1:] != number[:-1]])
            within = np.arange(len(number)) - np.maximum.accumulate(np.where(new, np.arange(len(number)), 0))
            starts = np.flatnonzero(within % size == 0)
            end = len(number) if last else int(starts[-1])
            starts = starts[starts < end]
            offsets = pa.array(np.append(starts, end), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, rows.column("item").slice(0, end).combine_chunks())
            keys = rows.column("key").take(pa.array(starts)).combine_chunks()
            pieces = pa.array((part << 40) + at + np.arange(len(starts)), pa.int64())
            at += len(starts)
            return pa.RecordBatch.from_arrays([keys, pieces, lists], ["key", "piece", "items"]), rows.slice(end)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                done, held = cut(held, False)
                yield done
        if held is not None and held.num_rows:
            yield cut(held, True)[0]

    return run


def baskets(rows: DataFrame, key: Column, items: Column) -> DataFrame:
    """key, piece, items: the sorted distinct folded items of each basket that has any, in lists of at most ``BLOCK``.

    Rows of one key are one basket; null keys do not count. A basket of any size is spread over ranges of (key, item), so it is
    never gathered; a list ends where a range does.
    """
    clean = F.array_distinct(F.filter(F.transform(items, folded), lambda x: x != ""))
    flat = rows.select(key.cast("string").alias("key"), F.explode(clean).alias("item")).filter("key is not null")
    # the reduction to distinct rows follows the range partitioning, so there is one shuffle
    ranges = flat.repartitionByRange("key", "item").dropDuplicates(["key", "item"]).sortWithinPartitions("key", "item")
    return ranges.mapInArrow(_pieces(BLOCK), "key string, piece bigint, items array<string>")


def _tiles(lists: DataFrame) -> DataFrame:
    """left, right: every list by itself, and every two lists of one basket."""
    alone = lists.select(F.col("items").alias("left"), F.lit(None).cast("array<string>").alias("right"))
    many = lists.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    place = F.row_number().over(Window.partitionBy("key").orderBy("piece")) - 1
    placed = lists.select("key", "piece").join(many, "key").withColumn("i", place)
    cells = placed.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda j: j != F.col("i"))))
    # a list goes to the cell of every other list of its basket; a cell holds two lists
    cells = cells.join(lists.select("piece", "items"), "piece")
    low = F.col("i") < F.col("j")
    both = cells.groupBy("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        F.first(F.when(low, F.col("items")), ignorenulls=True).alias("left"), F.first(F.when(~low, F.col("items")), ignorenulls=True).alias("right")
    )
    return alone.unionByName(both.select("left", "right"))


def _frame(names: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    x, y = names[a], names[b]
    swap = x > y
    return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "n": n.astype(np.int64)})


def _hashed(owner: np.ndarray, code: np.ndarray, n_codes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the pairs within each owner, whose rows are adjacent, some million pairs at a time."""
    size = np.bincount(owner) if len(owner) else np.empty(0, dtype=np.int64)
    end = np.cumsum(size)[owner] if len(owner) else owner
    later = end - np.arange(len(owner)) - 1
    upto = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _STEP, side="right")) - 1)
        k = later[at:to]
        first = np.repeat(np.arange(at, to), k)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
        low, high = np.minimum(code[first], code[second]), np.maximum(code[first], code[second])
        key, n = np.unique(low.astype(np.int64) * n_codes + high, return_counts=True)
        yield key // n_codes, key % n_codes, n
        at = to


class _Side:
    """The lists of one side of a batch: their items coded, the heavy ones as a bit matrix, the light ones as rows."""

    def __init__(self, lists: pd.Series, codes: np.ndarray, heavy_of: np.ndarray, n_heavy: int):
        owner = np.repeat(np.arange(len(lists)), lists.map(len).to_numpy())
        h = heavy_of[codes]
        heavy = h >= 0
        self.bits = np.zeros((n_heavy, -(-len(lists) // 64) * 64), dtype=bool)
        self.bits[h[heavy], owner[heavy]] = True
        self.packed = np.packbits(self.bits, axis=1).view(np.uint64)
        self.here = np.flatnonzero(self.packed.any(axis=1))
        self.code, self.owner, self.n = codes[~heavy], owner[~heavy], len(lists)

    def probe(self, other: "_Side") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(light code, heavy item, count): lists in which a light item of this side meets a heavy one of the other."""
        if not len(self.code) or not len(other.here):
            return
        columns = np.ascontiguousarray(other.bits[other.here].T)
        by_code = np.argsort(self.code, kind="stable")
        for part in np.array_split(by_code, max(1, len(by_code) * len(other.here) // (1 << 24))):
            own = self.code[part]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            hits = np.add.reduceat(columns[self.owner[part]].astype(np.int32), starts, axis=0)
            row, column = np.nonzero(hits)
            yield own[starts][row], other.here[column], hits[row, column]


def _products(left: _Side, right: _Side, n_codes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the pairs of a light item of each side in one list, some million pairs at a time."""
    size = np.bincount(right.owner, minlength=right.n)
    start = np.cumsum(size) - size
    partners = size[left.owner]
    upto = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(left.owner):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _STEP, side="right")) - 1)
        k = partners[at:to]
        first = np.repeat(np.arange(at, to), k)
        second = start[left.owner[first]] + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
        a, b = left.code[first], right.code[second]
        key, n = np.unique(np.minimum(a, b).astype(np.int64) * n_codes + np.maximum(a, b), return_counts=True)
        yield key // n_codes, key % n_codes, n
        at = to


def _count(heavy_names: list[str]):
    order = pd.Index(heavy_names)
    heavy_list = np.asarray(order, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_heavy = len(order)
        dense = np.zeros((n_heavy, n_heavy), dtype=np.int64)

        def mixed(names: np.ndarray, found: Iterator) -> Iterator[pd.DataFrame]:
            for light, heavy, n in found:
                a, b = names[light], heavy_list[heavy]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": n.astype(np.int64)})

        def framed(names: np.ndarray, found: Iterator) -> Iterator[pd.DataFrame]:
            for a, b, n in found:
                if len(n):
                    yield _frame(names, a, b, n)

        for batch in batches:
            crossed = batch["right"].notna().to_numpy()
            for pair in (False, True):
                rows = batch[crossed == pair]
                if not len(rows):
                    continue
                sides = [rows["left"], rows["right"]] if pair else [rows["left"]]
                code, names = pd.factorize(np.concatenate([x for lists in sides for x in lists]))
                names, heavy_of = np.asarray(names, dtype=object), order.get_indexer(names)
                cut = np.cumsum([lists.map(len).sum() for lists in sides])[:-1]
                sides = [_Side(lists, part, heavy_of, n_heavy) for lists, part in zip(sides, np.split(code, cut))]
                left, right = sides[0], sides[-1]
                for i, x in enumerate(left.here):
                    rest = right.here if pair else left.here[i + 1 :]
                    dense[x, rest] += np.bitwise_count(left.packed[x] & right.packed[rest]).sum(axis=1, dtype=np.int64)
                yield from mixed(names, left.probe(right))
                if pair:
                    yield from mixed(names, right.probe(left))
                    yield from framed(names, _products(left, right, len(names)))
                else:
                    yield from framed(names, _hashed(left.owner, left.code, len(names)))
        a, b = np.nonzero(dense)
        if len(a):
            yield _frame(heavy_list, a, b, dense[a, b])

    return run


def pair_counts(sets: DataFrame, min_count: int = 1) -> DataFrame:
    """a, b (a < b by code points), ab, count_a, count_b, n_baskets, lift of every pair in at least ``min_count`` baskets.

    ``sets`` is what ``baskets`` gives; baskets of one item count in ``n_baskets``. An item counts once for a basket, so
    repeated items change nothing. Without baskets there are no rows.
    """
    sets = materialize(sets, "baskets")
    singles = materialize(sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")), "items")
    total, n_baskets = singles.agg(F.sum("n")).first()[0] or 0, sets.select("key").distinct().count()
    heavy = singles.filter(F.col("n") * MAX_HEAVY >= total).select("item").orderBy("item").limit(MAX_HEAVY)
    names = [row[0] for row in heavy.collect()]
    partial = _tiles(sets).mapInPandas(_count(names), _SCHEMA)
    pairs = partial.groupBy("a", "b").agg(F.sum("n").alias("ab")).filter(F.col("ab") >= min_count)
    pairs = pairs.join(singles.select(F.col("item").alias("a"), F.col("n").alias("count_a")), "a")
    pairs = pairs.join(singles.select(F.col("item").alias("b"), F.col("n").alias("count_b")), "b")
    lift = F.col("ab").cast("double") * n_baskets / (F.col("count_a").cast("double") * F.col("count_b"))
    return pairs.select("a", "b", "ab", "count_a", "count_b", F.lit(n_baskets).cast("bigint").alias("n_baskets"), lift.alias("lift"))
