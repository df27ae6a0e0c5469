"""Near-duplicate texts: every pair whose sets of word shingles have at least a given Jaccard similarity.

Exact copies (equal word sequences) are collapsed first. Each set is ordered from rare to frequent shingles. Two sets of the
sizes a <= b that are alike enough share at least ``need(a, b)`` shingles, so they meet in a shingle that both have within
their first ``size - need + 1``; a shingle is posted only that far. The posts of a shingle, sorted by size, form a tile in
which only sizes and ranks that can still reach the threshold are paired. A hashed bitmap of each set bounds the overlap of
a pair from above by bit counts; what remains is decided by intersecting the sorted arrays. Nothing is sampled or capped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm import sketch
from notegraph.operators.components import connected_components
from notegraph.scratch import materialize

WORDS = 3
THRESHOLD = 0.5
#: A shingle that may be in more sets than this has its tile cut into blocks by the hash of the set.
HOT = 2048
#: The tiles are spread over a bucket for each so many words, but at least one for each core: a set's bitmap goes once to every
#: bucket where it has posts, so more buckets than the data needs cost space.
BUCKET_WORDS = 2_500_000
#: The sketch of shingle counts has a bucket of one byte for each word of the collection, but between 2^16 and 2^26.
SKETCH_BITS = (16, 26)
_PAIRS_AT_ONCE = 1 << 21
#: A text with more possible partners than this has the cell in which it is compared split.
_PARTNERS = 64
#: Texts that are posted at once: their number takes the 13 bits above 8 bits of rarity and 43 bits of the shingle.
_TEXTS_AT_ONCE = 1 << 13
_TEXT, _RARITY = np.uint64(51), np.uint64(43)
_TILE_SCHEMA = "bucket int, block binary"
_PAIR_SCHEMA = "lo bigint, hi bigint"
_INDEX, _PROBE = 1, 2

_random = np.random.default_rng(20_240_315)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.cumprod(np.full(64, 0x94D049BB133111EB, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' numbers, each turned by the byte's place, summed and mixed."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts, length = offsets[:-1] - offsets[0], np.diff(offsets)
    out = np.zeros(len(words), dtype=np.uint64)
    if len(raw):
        place = np.arange(len(raw)) - np.repeat(starts, length)
        out[length > 0] = np.add.reduceat(_BYTES[raw] * _PLACES[place & 63], starts[length > 0])
    return _mix(out)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 56-bit shingle) of every run of ``words`` words; the words of a text are separated by single spaces."""
    parts = pc.split_pattern(texts, " ")
    size = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = parts.flatten().dictionary_encode()
    word = _word_hashes(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    n = len(word) - words + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    whole = owner[:n] == owner[words - 1 :]
    key = word[:n].copy()
    for k in range(1, words):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + word[k : n + k])
    return owner[:n][whole], key[whole] >> np.uint64(8)


def sorted_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): the sorted distinct shingles of text i stand at bounds[i] : bounds[i + 1]."""
    owner, key = shingles(texts, words)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[first], key[first]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), key


@dataclass(frozen=True)
class Join:
    words: int
    threshold: float
    buckets: int
    bits: int
    hot: int = HOT

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of sets of these sizes that are alike enough."""
        return np.ceil(self.threshold / (1 + self.threshold) * (a + b) - 1e-9).astype(np.int64)

    def widths(self, size: np.ndarray) -> np.ndarray:
        """Bits of the bitmap of a set: the power of two from twice its size on, at least 64."""
        return (64 * 2 ** np.ceil(np.log2(np.maximum(size / 32, 1)))).astype(np.int64)

    def posts(self, levels: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """For each bucket of tiles a block of the sets that have posts there, with their bitmaps and posts."""
        owner, key = shingles(batch.column("text"), self.words)
        # text, rarity and shingle in one number: sorted, each set stands together with its rare shingles first
        rarity = levels[sketch.bucket(key, self.bits)].astype(np.uint64)
        packed = np.sort((owner.astype(np.uint64) << _TEXT) | (rarity << _RARITY) | (key >> np.uint64(56 - int(_RARITY))))
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
        owner, rarity = (packed >> _TEXT).astype(np.int64), ((packed >> _RARITY) & np.uint64(255)).astype(np.uint8)
        key = packed & ((np.uint64(1) << _RARITY) - np.uint64(1))
        size = np.bincount(owner, minlength=batch.num_rows)
        bounds = np.concatenate([[0], np.cumsum(size)])
        # bitmaps, one after the other
        width = self.widths(size)
        offset = np.concatenate([[0], np.cumsum(width)])
        image = np.zeros(offset[-1], dtype=bool)
        image[offset[owner] + (_mix(key) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
        image, offset = np.packbits(image, bitorder="little"), offset // 8
        rank = np.arange(len(key)) - bounds[:-1][owner] + 1
        own = size[owner]
        reach = own - np.ceil(self.threshold * own - 1e-9).astype(np.int64) + 1
        at = np.flatnonzero((rarity > 1) & (rank <= reach))
        if not len(at):
            return
        role = _PROBE + _INDEX * (rank[at] <= own[at] - self.need(own[at], own[at]) + 1)
        tile = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint64)
        blocks = np.ceil(sketch.at_most(rarity[at]) / self.hot).astype(np.int64)
        ref = batch.column("ref").to_numpy()
        cool = blocks <= 1
        parts = [(owner[at][cool], tile[cool], rank[at][cool], role[cool])]
        for kind in (_INDEX, _PROBE):
            hot = np.flatnonzero(~cool & ((role & kind) > 0))
            g = blocks[hot]
            x = np.repeat(hot, g)
            g, others = np.repeat(g, g), np.arange(len(x)) - np.repeat(np.cumsum(g) - g, g)
            mine = ref[owner[at[x]]] % g
            cells = mine * g + others if kind == _INDEX else others * g + mine
            cell = _mix((tile[x] << np.uint64(32)) + cells.astype(np.uint64)) & np.uint64(0xFFFFFFFF)
            parts.append((owner[at[x]], cell, rank[at[x]], np.full(len(x), kind)))
        row, tile, rank, role = (np.concatenate(x) for x in zip(*parts))
        target = (_mix(tile + np.uint64(1)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((row, target))
        row, target, tile, rank = row[order], target[order], tile[order].astype(np.uint32), (rank << 2 | role)[order]
        # one block for each bucket: its sets with their bitmaps, and the posts of each, column by column
        cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(target, prepend=-1) != 0))
        edges = np.append(cut, len(row))
        bounds = np.searchsorted(target[cut], np.arange(self.buckets + 1))
        image = image.tobytes()
        buckets, blocks = [], []
        for k in np.flatnonzero(np.diff(bounds)):
            sets, span = slice(bounds[k], bounds[k + 1]), slice(edges[bounds[k]], edges[bounds[k + 1]])
            own = row[cut[sets]]
            bits = b"".join(image[offset[i] : offset[i + 1]] for i in own)
            columns = (ref[own], _narrow(size[own]), _narrow(np.diff(edges[bounds[k] : bounds[k + 1] + 1])), tile[span], _narrow(rank[span]))
            buckets.append(k)
            blocks.append(pickle.dumps((*columns, bits), protocol=5))
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one bucket of tiles that pass sizes, ranks and bit counts."""
        blocks = [pickle.loads(x) for batch in batches for x in batch.column("block").to_pylist()]
        if not blocks:
            return
        ref, size, count, tile, rank = (np.concatenate([b[i] for b in blocks]).astype(np.int64) for i in range(5))
        bitmaps = _Bitmaps(np.frombuffer(b"".join(b[5] for b in blocks), dtype=np.uint8), self.widths(size))
        del blocks
        row = np.repeat(np.arange(len(ref)), count)
        rank, role = rank >> 2, rank & 3
        order = np.lexsort((size[row], tile))
        tile, rank, role, row = tile[order], rank[order], role[order], row[order]
        own = size[row]
        # the partners of a post stand behind it, up to the largest size that can be alike
        place = (tile << 31) + own
        last = np.searchsorted(place, (tile << 31) + np.floor(own / self.threshold + 1e-9).astype(np.int64), side="right")
        begin = np.searchsorted(place, place, side="left")
        index = np.flatnonzero((role & _INDEX) > 0)
        reach = last[index] - begin[index] - 1
        index, reach = index[reach > 0], reach[reach > 0]
        upto = np.concatenate([[0], np.cumsum(reach)])
        a = 0
        while a < len(index):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + _PAIRS_AT_ONCE, side="right")) - 1)
            i = np.repeat(index[a:b], reach[a:b] + 1)
            k = reach[a:b] + 1
            j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            a = b
            least = self.need(own[i], own[j])
            ok = ((role[j] & _PROBE) > 0) & (row[i] != row[j]) & (rank[i] <= own[i] - least + 1) & (rank[j] <= own[j] - least + 1)
            x, y = row[i[ok]], row[j[ok]]
            key = np.unique(np.minimum(x, y) * len(ref) + np.maximum(x, y))
            x, y = key // len(ref), key % len(ref)
            bound = bitmaps.bound(x, y, size)
            ok = (bound >= self.need(size[x], size[y])) & (ref[x] != ref[y])
            x, y = ref[x[ok]], ref[y[ok]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["lo", "hi"])

    def verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that are alike enough, by intersecting the sorted shingles; a cell's texts and pairs stand together."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            cell = held.column("cell").to_numpy()
            end = int(np.searchsorted(cell, cell[-1], side="left"))
            if end:
                yield from self._alike(held.slice(0, end))
                held = held.slice(end).combine_chunks()
        if held is not None:
            yield from self._alike(held)

    def _alike(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        is_text = pc.is_valid(rows.column("text"))
        given = rows.filter(is_text)
        refs, first = np.unique(given.column("lo").to_numpy(), return_index=True)
        bounds, key = sorted_sets(given.column("text").take(pa.array(first)).combine_chunks(), self.words)
        pairs = rows.filter(pc.invert(is_text))
        lo, hi = pairs.column("lo").to_numpy(), pairs.column("hi").to_numpy()
        x, y = np.searchsorted(refs, lo), np.searchsorted(refs, hi)
        size = np.diff(bounds)
        upto = np.concatenate([[0], np.cumsum(size[x] + size[y])])
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + _PAIRS_AT_ONCE, side="right")) - 1)
            # a shingle of both sides of a pair stands twice among the pair's sorted shingles
            ends = np.concatenate([x[a:b], y[a:b]])
            n = size[ends]
            owner = np.repeat(np.tile(np.arange(b - a), 2), n)
            both = key[np.repeat(bounds[:-1][ends] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
            order = np.lexsort((both, owner))
            owner, both = owner[order], both[order]
            twice = (owner[1:] == owner[:-1]) & (both[1:] == both[:-1])
            shared = np.bincount(owner[1:][twice], minlength=b - a)
            similarity = shared / np.maximum(size[x[a:b]] + size[y[a:b]] - shared, 1)
            kept = similarity >= self.threshold
            yield pa.RecordBatch.from_arrays([pa.array(lo[a:b][kept]), pa.array(hi[a:b][kept]), pa.array(similarity[kept])], ["lo", "hi", "similarity"])
            a = b


class _Bitmaps:
    """Bitmaps of different widths; a pair is compared at the smaller width, to which the other is folded."""

    def __init__(self, flat: np.ndarray, widths: np.ndarray):
        self.width = widths
        self.at = np.zeros(len(widths), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        starts = np.concatenate([[0], np.cumsum(widths // 8)])
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            self.at[own] = np.arange(len(own))
            self.rows[int(w)] = flat[starts[own][:, None] + np.arange(w // 8)].view(np.uint64)

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        wide = np.empty((len(rows), width // 64), dtype=np.uint64)
        for w in np.unique(self.width[rows]):
            own = np.flatnonzero(self.width[rows] == w)
            part = self.rows[int(w)][self.at[rows[own]]]
            while part.shape[1] > wide.shape[1]:
                half = part.shape[1] // 2
                part = part[:, :half] | part[:, half:]
            wide[own] = part
        return wide

    def bound(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Upper bound of the overlap: a bit that only one side has stands for at least one shingle that only it has."""
        out = np.zeros(len(x), dtype=np.int64)
        narrow = np.minimum(self.width[x], self.width[y])
        for w in np.unique(narrow):
            at = np.flatnonzero(narrow == w)
            a, b = self._folded(x[at], int(w)), self._folded(y[at], int(w))
            only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            out[at] = np.minimum(size[x[at]] - only_a, size[y[at]] - only_b)
        return out


@dataclass(frozen=True)
class Similar:
    """members (id, ref): the class of exact copies of each record; links (lo, hi, similarity): the alike classes."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """id_a < id_b of every pair of records, copies included."""
        a = self.members.select(F.col("id").alias("x"), F.col("ref").alias("lo"))
        b = self.members.select(F.col("id").alias("y"), F.col("ref").alias("hi"))
        across = self.links.select("lo", "hi").join(a, "lo").join(b, "hi").select("x", "y")
        copies = a.join(b, F.col("lo") == F.col("hi")).filter("x < y").select("x", "y")
        return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def class_links(self) -> DataFrame:
        """class_a < class_b, similarity of every two classes of exact copies that are alike, each named by its smallest id."""
        names = self.members.groupBy("ref").agg(F.min("id").alias("name"))
        both = self.links.join(names.select(F.col("ref").alias("lo"), F.col("name").alias("a")), "lo").join(names.select(F.col("ref").alias("hi"), F.col("name").alias("b")), "hi")
        return both.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "similarity")

    def groups(self) -> DataFrame:
        """id, class_id (smallest id of its exact copies), group_id (smallest id it is connected with), n_links (records alike)."""
        classes = self.members.groupBy("ref").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
        ends = self.links.select(F.col("lo").alias("ref"), F.col("hi").alias("other")).unionByName(
            self.links.select(F.col("hi").alias("ref"), F.col("lo").alias("other"))
        )
        linked = ends.join(classes.select(F.col("ref").alias("other"), F.col("n").alias("m")), "other").groupBy("ref").agg(F.sum("m").alias("m"))
        parts = connected_components(self.links.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        whole = classes.join(parts.withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
        first = whole.groupBy("component").agg(F.min("class_id").alias("group_id"))
        known = whole.join(first, "component").join(linked, "ref", "left")
        counted = known.select("ref", "class_id", "group_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
        return self.members.join(counted, "ref").select("id", "class_id", "group_id", "n_links")


def near_duplicates(records: DataFrame, key: Column, text: Column, words: int = WORDS, threshold: float = THRESHOLD, hot: int = HOT) -> Similar:
    """All pairs of records whose sets of ``words``-word shingles have a Jaccard similarity of at least ``threshold``.

    Words are the maximal runs of letters and digits of the lower-cased text. Records with a null key or fewer than ``words``
    words (also null and empty texts) are in no pair and have no row; repeated rows of a key are one record, and of different
    texts of one key one counts, that with the smallest hash. Long texts are compared whole. No records give empty results.
    Other columns are ignored.
    """
    spark = records.sparkSession

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pc.utf8_lower(batch.column("text"))
            spaced = pc.replace_substring_regex(low, pattern=r"[^\pL\pN]+", replacement=" ")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.utf8_trim(spaced, characters=" ")], ["id", "text"])

    base = records.select(key.cast("string").alias("id"), text.cast("string").alias("text")).filter("id is not null and text is not null")
    base = base.mapInArrow(plain, "id string, text string")
    base = base.filter(F.length("text") - F.length(F.replace("text", F.lit(" "))) >= words - 1)
    base = materialize(base.select("id", F.xxhash64("text").alias("ref"), "text", F.monotonically_increasing_id().alias("row")), "words")
    repeated = base.groupBy("ref").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated.select("ref", "first"), "copies")
    texts = base.select("ref", "text", "row").join(repeated, "ref", "left").filter("first is null or row = first").select("ref", "text")

    n_words = base.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)).first()[0] or 1
    bits = min(max(int(np.ceil(np.log2(n_words))), SKETCH_BITS[0]), SKETCH_BITS[1])
    # where the sketch is much smaller than the collection, a bucket's count says little below a few times the mean
    hot = max(hot, 4 * (n_words >> bits))
    counts = sketch.build(texts.select("text"), lambda batch: shingles(batch.column("text"), words)[1], bits)
    levels = spark.sparkContext.broadcast(counts)
    join = Join(words, threshold, max(spark.sparkContext.defaultParallelism, -(-n_words // BUCKET_WORDS)), bits, hot)

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                yield from join.posts(levels.value, batch.slice(at, _TEXTS_AT_ONCE))

    tiles = texts.mapInArrow(posts, _TILE_SCHEMA).repartitionById(join.buckets, F.col("bucket"))
    maybe = materialize(tiles.mapInArrow(join.tiles, _PAIR_SCHEMA).distinct(), "candidates")

    wanted = spark.sparkContext.broadcast(
        sketch.build(maybe, lambda batch: np.concatenate([batch.column("lo").to_numpy(), batch.column("hi").to_numpy()]).view(np.uint64), 22)
    )

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column("ref").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(wanted.value[sketch.bucket(refs, 22)] > 0))

    sides = texts.mapInArrow(involved, "ref bigint, text string")
    return Similar(base.groupBy("id").agg(F.min("ref").alias("ref")), _cells(maybe, sides).mapInArrow(join.verify, _PAIR_SCHEMA + ", similarity double"))


def _cells(maybe: DataFrame, texts: DataFrame) -> DataFrame:
    """cell, lo, hi, text in order of the cells: the texts (as lo) and the pairs of each cell, so that a text is sent once to a cell.

    Texts of one family have the same smallest partner, which names their cell; a text with many partners has the cell split
    both ways, so no cell is large.
    """
    ends = maybe.select(F.explode(F.array(F.struct(F.col("lo").alias("ref"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("ref"), F.col("lo").alias("other")))).alias("e"))
    lead = ends.groupBy("e.ref").agg(F.least(F.min("e.other"), F.first("e.ref")).alias("lead"), F.ceil(F.count("*") / _PARTNERS).alias("g"))
    split = F.xxhash64("lead", "g", F.pmod(F.xxhash64("lo"), F.col("g")), F.pmod(F.xxhash64("hi"), F.col("g")))
    pairs = maybe.join(lead.withColumnRenamed("ref", "lo"), "lo").select(split.alias("cell"), "lo", "hi")
    pairs = materialize(pairs, "cells")
    wanted = pairs.select("cell", F.explode(F.array("lo", "hi")).alias("ref")).distinct()
    given = wanted.join(texts, "ref").select("cell", F.col("ref").alias("lo"), F.lit(None).cast("bigint").alias("hi"), "text")
    rows = given.unionByName(pairs.withColumn("text", F.lit(None).cast("string")))
    return rows.repartition("cell").sortWithinPartitions("cell")
