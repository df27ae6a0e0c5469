"""Products of sparse rows: which rows (id, weighted terms) go best with which asked ones, without a join on the terms.

A join on terms brings a row for each term that two sides share, so what is shuffled grows with the square of the input. Here
a task holds a share of its rows as arrays and reads the asked ones from the scratch folder batch by batch, share after share. Where
the k best are asked it keeps the best so far of each asked row, which also bound what later shares have to form, and only those
leave it; there are as few tasks over all rows as keeps what leaves them all within the size of the rows. Nothing is left out: of positive weights, only products that cannot bring a row among
the best are not formed, and where that spares little every asked row meets every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegraph.scratch import materialize, read, write
from notegraph.sources.tables import spread

#: Terms held at once by a task (about 200 bytes each while they are put in order), best rows kept, cells of the matrix of products,
#: products listed at once, asked rows read at once.
_HELD, _KEPT, _CELLS, _LISTED, _ASKED = 1_500_000, 2_000_000, 1 << 19, 1 << 20, 1 << 14
#: Best rows that may leave all tasks of a product anyhow, and stored bytes of the rows for each further one.
_LEFT, _LEFT_BYTES = 1_000_000, 24
#: Rows of a term that are listed without looking at their weight, asked terms bounded at once, share of the rows from which on an
#: asked row meets them all.
_SHORT, _BOUNDED, _MANY = 32, 1 << 16, 0.2
#: A term of many rows that many ask for is multiplied as a dense row when its share of the products is above this.
_DENSE, _DENSE_CELLS = 0.005, 1 << 23
_TINY = float(np.nextafter(0, 1))
Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def tables(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of a scratch table, read by a worker."""
    system, at = pafs.FileSystem.from_uri(path)
    for file in sorted(x.path for x in system.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet")):
        with system.open_input_file(file) as source:
            yield from pq.ParquetFile(source).iter_batches(rows, columns=columns)


@dataclass(frozen=True)
class Files:
    """Rows of a scratch table whose files the workers read themselves: its columns, and what makes rows for products of a batch."""

    table: DataFrame
    columns: tuple[str, ...]
    made: Callable[[pa.RecordBatch], pa.RecordBatch]
    #: The column that becomes the part, if it is not called so.
    part: str | None = None


def mapped(rows: DataFrame | Files, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: dict[str, T.DataType]) -> DataFrame:
    """``run`` over the batches of rows; of Files a task has a file."""
    schema = T.StructType([T.StructField(*x) for x in kinds.items()])
    if isinstance(rows, DataFrame):
        return rows.mapInArrow(run, schema)
    files, columns, made = sorted(rows.table.inputFiles()), list(rows.columns), rows.made

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch["id"].to_pylist():
                system, file = pafs.FileSystem.from_uri(files[at])
                with system.open_input_file(file) as source:
                    for part in pq.ParquetFile(source).iter_batches(_ASKED, columns=columns):
                        yield made(part)

    return rows.table.sparkSession.range(0, len(files), 1, max(len(files), 1)).mapInArrow(lambda batches: run(opened(batches)), schema)


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch


def stored(rows: DataFrame, label: str = "rows") -> Files:
    """The rows (id, terms, weights and more) in a scratch table that the workers read themselves."""
    return Files(materialize(rows, label), tuple(rows.columns), _plain)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each item, and the items; a null list has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten()


def _weights(rows: pa.Table, doc: np.ndarray, weigh: Weigh | None) -> np.ndarray:
    """The weights of the terms of all rows; of rows with doc_len and avg_len ``weigh`` makes them from the counts."""
    _, weights = _flat(_whole(rows["weights"]))
    weights = weights.to_numpy(zero_copy_only=False)
    if weigh is None or "doc_len" not in rows.column_names:
        return weights
    return weigh(weights, *(_whole(rows[x]).to_numpy(zero_copy_only=False)[doc] for x in ("doc_len", "avg_len")))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in shares of at most ``_HELD`` terms or one row."""
    held, n = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            before = int(sizes[at - 1]) if at else 0
            to = max(int(np.searchsorted(sizes, before + _HELD - n, side="right")), at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                n += int(sizes[to - 1]) - before
                at = to
            if at < len(sizes):
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Share:
    """Rows by id, their terms as numbers, and by term where it stands."""

    def __init__(self, rows: pa.Table, weigh: Weigh | None = None):
        parts = [("part", "ascending")] if "part" in rows.column_names else []
        rows = rows.take(pc.sort_indices(rows, sort_keys=[*parts, ("id", "ascending")]))
        self.ids = _whole(rows["id"])
        self.n = len(self.ids)
        self.part = _whole(rows["part"]) if parts else None
        self.starts = np.zeros(1, dtype=np.int64)
        if parts:
            number = _whole(self.part).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            self.starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        doc, terms = _flat(_whole(rows["terms"]))
        coded = terms.dictionary_encode()
        self.terms = coded.dictionary
        weight = _weights(rows, doc, weigh)
        self.least_weight = float(weight.min(initial=np.inf))
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * self.n + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        # a term that stands twice in a row is one with the sum of the weights
        self.key, self.weight = key[first], np.add.reduceat(weight[order], first) if len(first) else weight
        code, doc = np.divmod(self.key, max(self.n, 1))
        self.doc = doc.astype(np.int32)
        self.df = np.bincount(code, minlength=len(self.terms))
        self.at = np.cumsum(self.df) - self.df
        # lists of the rows of a term in a part, from the largest weight to the smallest
        within = np.searchsorted(self.starts, doc, side="right") - 1
        list_ = np.cumsum(np.r_[False, (code[1:] != code[:-1]) | (within[1:] != within[:-1])][: len(code)])
        begins = np.flatnonzero(np.r_[True, list_[1:] != list_[:-1]][: len(code)])
        self.list_part, self.list_code, self.list_at = within[begins], code[begins], begins
        self.list_size = np.diff(np.r_[begins, len(code)])
        self.n_lists = np.bincount(self.list_code, minlength=len(self.terms))
        self.first_list = np.cumsum(self.n_lists) - self.n_lists
        order = np.lexsort((-self.weight, list_))
        self.falling_doc, self.falling = self.doc[order], self.weight[order]

    def listed(self, code: np.ndarray, row: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells of the matrix (asked row, row) and what each shared term adds to them."""
        upto = np.cumsum(self.df[code])
        at = 0
        while at < len(code):
            before = upto[at - 1] if at else 0
            to = max(int(np.searchsorted(upto, before + _LISTED, side="right")), at + 1)
            n = self.df[code[at:to]]
            index = np.arange(upto[to - 1] - before) + np.repeat(self.at[code[at:to]] - (upto[at:to] - n - before), n)
            yield self.doc[index] + np.repeat(row[at:to] * self.n, n), self.weight[index] * np.repeat(weight[at:to], n)
            at = to

    def known(self, asked: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and weight of the asked terms that a row of the share has."""
        row, terms = _flat(asked["terms"])
        _, weight = _flat(asked["weights"])
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        known = code >= 0
        return row[known], code[known], weight.to_numpy(zero_copy_only=False)[known]

    def picked(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, k: int, least: float, own: np.ndarray | None, carried: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """Asked row, row and score of at least the k best of each part, for all-positive weights; an asked row that has to meet
        more than ``_MANY`` of the rows comes as the only row of a tuple of one. Scores under ``carried`` of an asked row do not count.

        The products with the largest weights of each term give a score that the k-th best reaches. Rows that reach it have a
        product above a bound, as the bounds of an asked row add up to half of that score; only such products are formed, and
        of the rows that they bring to the other half the missing ones are looked up.
        """
        ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)]) + 1
        lists, most = np.r_[0, np.cumsum(self.n_lists[code])], min(_BOUNDED, max(_LISTED // (2 * k), 1))
        at = 0
        while at < len(row):
            to = int(ends[max(int(np.searchsorted(lists[ends], lists[at] + most, side="right")) - 1, int(np.searchsorted(ends, at, side="right")))])
            yield from self._picked(row[at:to], code[at:to], weight[at:to], k, least, own, carried)
            at = to

    def _prefixes(self, list_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the first n rows of each list: the place of the list among those given, and their places in ``falling``."""
        upto = np.cumsum(n)
        of = np.repeat(np.arange(len(n)), n)
        return of, np.arange(len(of)) + np.repeat(self.list_at[list_] - (upto - n), n)

    def _summed(self, group: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = group * self.n + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        total = np.add.reduceat(value[order], first) if len(first) else value[:0]
        return *np.divmod(key[first], self.n), total

    def _picked(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, k: int, least: float, own: np.ndarray | None, carried: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        n = self.n_lists[code]
        upto = np.cumsum(n)
        list_ = np.arange(int(n.sum())) + np.repeat(self.first_list[code] - (upto - n), n)
        row, weight = np.repeat(row, n), np.repeat(weight, n)
        group = row * len(self.starts) + self.list_part[list_]
        order = np.argsort(group, kind="stable")
        group, list_, row, weight = group[order], list_[order], row[order], weight[order]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        group, asked = np.cumsum(np.r_[False, group[1:] != group[:-1]][: len(group)]), row[begins]
        size, top = self.list_size[list_], weight * self.falling[self.list_at[list_]]
        n_terms = np.diff(np.r_[begins, len(group)])

        def others(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
            return np.ones(len(g), dtype=bool) if own is None else own[asked[g]] != doc

        # a score that the k best reach
        floor = np.full(len(begins), max(least, 0.0))
        if carried is not None:
            floor = np.maximum(floor, carried[asked])
        long = size > max(_SHORT, 2 * k)
        some = np.flatnonzero(np.isin(group, group[long]))
        of, place = self._prefixes(list_[some], np.minimum(size[some], 2 * k))
        g, doc, total = self._summed(group[some[of]], self.falling_doc[place], self.falling[place] * weight[some[of]])
        kept = others(g, doc)
        g, total = g[kept], total[kept]
        order = np.lexsort((-total, g))
        g, total = g[order], total[order]
        kth = np.flatnonzero(np.arange(len(g)) - np.searchsorted(g, g) == k - 1)
        floor[g[kth]] = np.maximum(floor[g[kth]], total[kth] - 2e-9)
        # products under ``bound`` are not formed: bounds are equal but where no product of a term is as large
        limited = np.flatnonzero(long)
        spare = np.where((np.bincount(group[limited], minlength=len(begins)) == 1) & (n_terms == 1), floor, floor / 2) * (1 - 1e-9)
        limited = limited[np.lexsort((top[limited], group[limited]))]
        lg, lt = group[limited], top[limited]
        before = np.cumsum(lt) - lt
        start = np.searchsorted(lg, lg)
        left = np.searchsorted(lg, lg, side="right") - np.arange(len(lg))
        level = (spare[lg] - (before - before[start] if len(lg) else before)) / left
        cut = level < lt  # from the first such term on all have the bound of that one
        first_cut = np.full(len(begins), np.inf)
        np.minimum.at(first_cut, lg[cut], np.flatnonzero(cut))
        after = np.arange(len(lg)) >= first_cut[lg]
        bound = np.full(len(lg), np.inf)
        bound[after] = np.maximum(level[first_cut[lg[after]].astype(np.int64)], 0.0)
        least_weight = bound / weight[limited]
        rest = np.bincount(lg, np.minimum(bound, lt), len(begins))
        low, high, base = np.zeros(len(limited), dtype=np.int64), np.where(after, size[limited], 0), self.list_at[list_[limited]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            reach = self.falling[base[open_] + mid] >= least_weight[open_]
            low[open_[reach]] = mid[reach] + 1
            high[open_[~reach]] = mid[~reach]
        formed = size.copy()
        formed[limited] = low
        work = np.bincount(row - row[0], formed)
        many = np.flatnonzero(work > _MANY * self.n)
        for r in many:
            yield (row[0] + r,)
        formed[np.isin(row - row[0], many)] = 0
        upto = np.cumsum(np.add.reduceat(formed, begins)) if len(begins) else formed
        limits = np.searchsorted(lg, np.arange(len(begins) + 1))
        a = 0
        while a < len(begins):
            b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _LISTED, side="right")), a + 1)
            here = slice(begins[a], begins[b] if b < len(begins) else len(group))
            of, place = self._prefixes(list_[here], formed[here])
            g, doc, total = self._summed(group[here][of], self.falling_doc[place], self.falling[place] * weight[here][of])
            kept = others(g, doc) & (total >= floor[g] - rest[g] - 1e-9)
            g, doc, total = g[kept], doc[kept], total[kept]
            m = limits[g + 1] - limits[g]
            pair = np.repeat(np.arange(len(g)), m)
            term = np.arange(len(pair)) + np.repeat(limits[g] - (np.cumsum(m) - m), m)
            wanted = self.list_code[list_[limited[term]]] * self.n + doc[pair]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            missing = (self.key[place] == wanted) & (self.weight[place] < least_weight[term])
            pair, place, term = pair[missing], place[missing], term[missing]
            total = total + np.bincount(pair, self.weight[place] * weight[limited[term]], len(g))
            kept = (total >= floor[g]) & (total >= least)
            g, doc, total = g[kept], doc[kept], total[kept]
            order = np.lexsort((doc, -_rounded(total), g))
            g, doc, total = g[order], doc[order], total[order]
            kept = np.arange(len(g)) - np.searchsorted(g, g) < k
            yield asked[g[kept]], doc[kept], total[kept]
            a = b

    def products(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, n_asked: int, signed: bool) -> Iterator[tuple[int, np.ndarray, float]]:
        """The number of the first asked row, the products of some asked rows with all rows, and the least product of a pair that
        shares a term: where none is shared there is 0, or -inf if ``signed``."""
        share = np.bincount(code, minlength=len(self.terms)) / max(n_asked, 1) * (self.df / max(self.n, 1))
        often = np.flatnonzero(share > _DENSE) if not signed else np.empty(0, dtype=np.int64)
        often = often[np.argsort(-share[often], kind="stable")][: max(_DENSE_CELLS // max(self.n, 1), 1)]
        place = np.full(len(self.terms), -1)
        place[often] = np.arange(len(often))
        dense = np.zeros((len(often), self.n))
        for i, c in enumerate(often):
            here = slice(self.at[c], self.at[c] + self.df[c])
            dense[i] = np.bincount(self.doc[here], self.weight[here], self.n)
        step = max(_CELLS // max(self.n, 1), 1)
        for first in range(0, n_asked, step):
            to = min(first + step, n_asked)
            a, b = np.searchsorted(row, [first, to])
            if a == b:
                continue
            r, c, w = row[a:b] - first, code[a:b], weight[a:b]
            at = place[c]
            many = at >= 0
            if many.any():
                left = np.bincount(r[many] * len(often) + at[many], w[many], (to - first) * len(often))
                cells = (left.reshape(to - first, -1) @ dense).ravel()
                r, c, w = r[~many], c[~many], w[~many]
            else:
                cells = np.zeros((to - first) * self.n)
            met = np.zeros(len(cells), dtype=bool) if signed else None
            for key, value in self.listed(c, r, w):
                cells += np.bincount(key, value, len(cells))
                if signed:
                    met[key] = True
            if signed:
                cells[~met] = -np.inf
            yield first, cells.reshape(to - first, self.n), -1e300 if signed else _TINY


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e9 + 0.5)


def _first(cells: np.ndarray, k: int, least: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest cells of each row that reach ``least`` (of all rows or of each); of equal ones the first."""
    n, width = cells.shape[1], max(cells.shape[1] // (8 * k), 1)
    cut = n // width * width
    tops = cells[:, :cut].reshape(len(cells), -1, width).max(axis=2)
    bound = np.full(len(cells), -np.inf)
    if tops.shape[1] >= k:  # k groups have a cell as large, so the k-th largest cell is no smaller
        bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    row, column = np.divmod(np.flatnonzero(cells >= np.maximum(bound - 2e-9, least)[:, None]), n)
    value, floor = _rounded(cells[row, column]), _rounded(bound)[row]
    equal = value == floor
    count = np.r_[0, np.cumsum(equal)]
    kept = (value > floor) | (equal & (count[1:] - count[np.searchsorted(row, row)] <= k))
    row, column, value = row[kept], column[kept], value[kept]
    order = np.lexsort((column, -value, row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


class _Best:
    """The k best rows so far of each asked row of a batch (and part), by score rounded to nine places and id."""

    def __init__(self, asked: int, k: int, whole: bool):
        self.k, self.ids, self.part = k, None, None
        self.row, self.score = np.empty(0, dtype=np.int64), np.empty(0)
        #: Scores that the k best of an asked row reach; None where they are of each part.
        self.reached = np.full(asked, -np.inf) if whole else None

    def add(self, row: np.ndarray, ids: pa.Array, score: np.ndarray, part: pa.Array | None) -> None:
        if self.ids is not None:
            row, score, ids = np.r_[self.row, row], np.r_[self.score, score], pa.concat_arrays([self.ids, ids])
            part = None if part is None else pa.concat_arrays([self.part, part])
        group = row
        if part is not None:
            coded = part.dictionary_encode(null_encoding="encode")
            group = row * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        falling = -_rounded(score)
        order = np.lexsort((falling, group))
        same = (group[order[1:]] == group[order[:-1]]) & (falling[order[1:]] == falling[order[:-1]])
        if same.any():  # only there the ids decide
            tied = order[np.r_[False, same] | np.r_[same, False]]
            place = np.zeros(len(row), dtype=np.int64)
            place[tied[pc.sort_indices(ids.take(pa.array(tied))).to_numpy(zero_copy_only=False)]] = np.arange(len(tied))
            order = np.lexsort((place, falling, group))
        g = group[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        if self.reached is not None:
            last = order[rank == self.k - 1]
            self.reached[row[last]] = score[last] - 2e-9
        order = order[rank < self.k]
        self.row, self.score, self.ids = row[order], score[order], ids.take(pa.array(order))
        self.part = None if part is None else part.take(pa.array(order))


def _matched(path: str, k: int | None, least: float | None, others: bool, after: bool, names: list[str], weigh: Weigh | None = None, mine: tuple[int, int] = (0, 1)) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What runs over rows; of the asked ones it takes ``mine[0]`` and every ``mine[1]``-th after it."""

    def questions() -> Iterator[pa.RecordBatch]:
        for batch in tables(path, ["query_id", "terms", "weights"], _ASKED * mine[1]):
            part = batch if mine[1] == 1 else batch.take(pa.array(np.arange(mine[0], len(batch), mine[1])))
            if len(part):
                yield part

    def made(query: pa.Array, row: np.ndarray, ids: pa.Array, score: np.ndarray, part: pa.Array | None) -> pa.RecordBatch:
        columns = {"query_id": query.take(pa.array(row)), "id": ids, "score": pa.array(score), "part": part}
        return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[_Best] = []
        for rows in _shares(batches):
            share = _Share(rows, weigh)
            ends = np.r_[share.starts[1:], share.n]
            for number, asked in enumerate(questions()):
                query = asked["query_id"]
                own = pc.fill_null(pc.index_in(query, value_set=share.ids), -1).to_numpy(zero_copy_only=False) if others else None
                if after:
                    next_ = np.searchsorted(share.ids.to_numpy(zero_copy_only=False), query.to_numpy(zero_copy_only=False), side="right")
                if k is not None and number == len(best):
                    best.append(_Best(len(asked), k, share.part is None))
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                reached = None if k is None else best[number].reached

                def out() -> Iterator[pa.RecordBatch]:
                    if found:
                        r, c, score = (np.concatenate(x) for x in zip(*found))
                        found.clear()
                        ids, part = share.ids.take(pa.array(c)), None if share.part is None else share.part.take(pa.array(c))
                        if k is None:
                            yield made(query, r, ids, score, part)
                        elif len(r):
                            best[number].add(r, ids, score, part)

                row, code, weight = share.known(asked)
                # with a weight that is not positive a pair that shares a term may have 0, unless ``least`` rules that out
                signed = (least is None or least <= 0) and bool(len(weight)) and (float(weight.min()) <= 0 or share.least_weight <= 0)
                full = np.arange(len(asked))
                if k is not None and len(row) and float(weight.min()) > 0 and share.least_weight > 0:
                    full = []
                    for some in share.picked(row, code, weight, k, _TINY if least is None else least, own, reached):
                        if len(some) == 1:
                            full.append(some[0])
                        else:
                            found.append(some)
                            if sum(len(x[0]) for x in found) > _LISTED:
                                yield from out()
                    full = np.array(full, dtype=np.int64)
                    some = np.isin(row, full)
                    row, code, weight = np.searchsorted(full, row[some]), code[some], weight[some]
                for at, cells, lowest in share.products(row, code, weight, len(full), signed):
                    floor = lowest if least is None else max(least, lowest)
                    if reached is not None:
                        floor = np.maximum(reached[full[at : at + len(cells)]], floor)
                    if others:
                        here = own[full[at : at + len(cells)]]
                        same = np.flatnonzero(here >= 0)
                        cells[same, here[same]] = -np.inf
                    for a, b in zip(share.starts, ends):
                        part = cells[:, a:b]
                        r, c = np.divmod(np.flatnonzero(part >= floor), b - a) if k is None else _first(part, k, floor)
                        if after:
                            later = c + a >= next_[full[r + at]]
                            r, c = r[later], c[later]
                        found.append((full[r + at], c + a, part[r, c]))
                    if sum(len(x[0]) for x in found) > _LISTED:
                        yield from out()
                yield from out()
        if best:
            for held, asked in zip(best, questions()):
                if held.ids is not None:
                    yield made(asked["query_id"], held.row, held.ids, held.score, held.part)

    return run


def _grid(cores: int, files: int, leaving: int, stored_bytes: int) -> tuple[int, int]:
    """Groups of the rows' files and of the asked rows of which every two meet in a task, if ``leaving`` best rows are kept by each
    group of files: what leaves all tasks is at most about the size of the rows, what a task keeps at most ``_KEPT``."""
    groups = max(min(cores, files, (_LEFT + stored_bytes // _LEFT_BYTES) // max(leaving, 1)), 1)
    asked = max(-(-cores // groups), -(-leaving // _KEPT))
    return max(min(groups, max(cores // asked, 1)), 1), asked


def _crossed(rows: Files, path: str, asked: DataFrame, k: int, parts: int, matched: Callable[[tuple[int, int]], Callable], kinds: dict[str, T.DataType]) -> DataFrame:
    """``matched`` by tasks over groups of the rows' files and of the asked rows."""
    spark = rows.table.sparkSession
    files, columns, prepared = sorted(rows.table.inputFiles()), list(rows.columns), rows.made
    leaving = read(spark, path, asked).count() * k * parts
    size = int(str(rows.table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    groups, shares = _grid(spark.sparkContext.defaultParallelism, len(files), leaving, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(group: int) -> Iterator[pa.RecordBatch]:
            for at in files[group::groups]:
                system, file = pafs.FileSystem.from_uri(at)
                with system.open_input_file(file) as source:
                    for part in pq.ParquetFile(source).iter_batches(_ASKED, columns=columns):
                        yield prepared(part)

        for batch in batches:
            for at in batch["id"].to_pylist():
                yield from matched((at // groups, shares))(opened(at % groups))

    n = groups * shares if files else 0
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, T.StructType([T.StructField(*x) for x in kinds.items()]))


def matches(rows: DataFrame | Files, asked: DataFrame, k: int | None = None, least: float | None = None, others: bool = False, after: bool = False, weigh: Weigh | None = None, parts: int = 1) -> DataFrame:
    """query_id, id, score (and part): the sum over shared terms of the products of both weights.

    ``rows`` has id, terms, weights (two arrays of one length; a term that stands twice counts twice) and may have a part;
    ``asked`` query_id, term, weight, or query_id, terms, weights once for each query. Pairs without a shared term do not count, nor scores under ``least`` (without it: if
    all weights are positive every pair counts that shares a term). ``k`` keeps at least the k best of each query (and part), by
    score rounded to nine places and id; ``others`` leaves out the row whose id is the query's, ``after`` (without k) those whose id is not
    larger. ``rows`` with doc_len and avg_len have counts as weights, of which ``weigh`` makes weights. ``parts`` says of about how many
    parts a query has best rows.
    """
    if "terms" in asked.columns:
        lists = asked
    else:
        terms = F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight")))
        lists = asked.filter("term is not null").groupBy("query_id").agg(terms.alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    path = write(lists, "asked")
    own = rows.table if isinstance(rows, Files) else rows
    kinds = {"query_id": asked.schema["query_id"].dataType}
    if isinstance(rows, Files) and rows.part:
        kinds["part"] = own.schema[rows.part].dataType
    elif "part" in own.columns:
        kinds["part"] = own.schema["part"].dataType
    kinds |= {"id": own.schema["id"].dataType, "score": T.DoubleType()}
    if isinstance(rows, DataFrame):
        rows = spread(rows.select("id", "terms", "weights", *(x for x in ("part", "doc_len", "avg_len") if x in rows.columns)))
    if k is None:
        return mapped(rows, _matched(path, k, least, others, after, list(kinds), weigh), kinds)
    rows = stored(rows) if isinstance(rows, DataFrame) else rows
    names = list(kinds)
    return _crossed(rows, path, lists, k, parts, lambda mine: _matched(path, k, least, others, after, names, weigh, mine), kinds)


def _leading(path: str, n: int, names: list[str], weigh: Weigh | None, lists: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shares(batches):
            doc, terms = _flat(_whole(rows["terms"]))
            coded = terms.dictionary_encode()
            code, value = coded.indices.to_numpy(zero_copy_only=False), np.full(len(coded.dictionary), np.nan)
            for batch in tables(path, ["term", "idf"], 1 << 16):
                at = pc.fill_null(pc.index_in(batch["term"], value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
                value[at[at >= 0]] = batch["idf"].to_numpy(zero_copy_only=False)[at >= 0]
            place = np.empty(len(value), dtype=np.int64)
            place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(value))
            weight = _weights(rows, doc, weigh) * value[code]
            order = np.lexsort((place[code], -_rounded(weight), doc))
            at = doc[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
            order, rank = order[rank <= n], rank[rank <= n]
            at = doc[order]
            if lists:
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
                upto = pa.array(np.r_[first, len(at)].astype(np.int32))
                weights = pa.ListArray.from_arrays(upto, pa.array(value[code[order]]))
                columns = {"query_id": _whole(rows["id"]).take(pa.array(at[first])), "terms": pa.ListArray.from_arrays(upto, terms.take(pa.array(order))), "weights": weights}
            else:
                columns = {"id": _whole(rows["id"]).take(pa.array(at)), "term": terms.take(pa.array(order)), "idf": pa.array(value[code[order]]), "weight": pa.array(weight[order]), "rank": pa.array(rank.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return run


def leading(rows: DataFrame | Files, values: DataFrame, n: int, weigh: Weigh | None = None, lists: bool = False) -> DataFrame:
    """id, term, idf, weight, rank: the n terms of each row (id, terms, weights; a term once) with the largest weight times the
    term's idf of ``values`` (term, idf), which every term has; with doc_len and avg_len as in ``matches``. ``lists`` gives
    query_id, terms, weights (the idf) instead, as ``matches`` asks with them."""
    own = rows.table if isinstance(rows, Files) else rows
    if lists:
        kinds = {"query_id": own.schema["id"].dataType, "terms": T.ArrayType(T.StringType()), "weights": T.ArrayType(T.DoubleType())}
    else:
        kinds = {"id": own.schema["id"].dataType, "term": T.StringType(), "idf": T.DoubleType(), "weight": T.DoubleType(), "rank": T.IntegerType()}
    path = write(values.select("term", "idf"), "values")
    if isinstance(rows, DataFrame):
        rows = spread(rows.select("id", "terms", "weights", *(x for x in ("doc_len", "avg_len") if x in rows.columns)))
    return mapped(rows, _leading(path, n, list(kinds), weigh, lists), kinds)


def best(scores: DataFrame, by: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k best of each group, by score rounded to nine places and id, with their place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "id"))
    return scores.withColumn(rank, place).filter(F.col(rank) <= k)
