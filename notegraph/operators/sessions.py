"""Sessions from the Cartesian tree over the gaps between an entity's consecutive events.

A node of the tree is a maximal run of events whose inner gaps are all at most ``gap_us`` (its height); the smaller of the
two gaps around it is ``parent_gap_us`` (null at the root). The sessions of a threshold ``t`` are exactly the nodes with
``gap_us <= t < parent_gap_us``, so one tree serves every gap setting.

The timeline is range-partitioned on (entity, time). An entity of any size is therefore spread over as many chunks as its
rows need; each chunk builds its own tree and closes every node that no neighbouring chunk can change. What stays open is
the chunk's skeleton: the atoms between strict running maxima of the gaps seen from either end. Skeletons are merged
``FAN_IN`` chunks at a time, with the same tree builder working on atoms instead of events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.scratch import materialize

FAN_IN = 32
#: A chunk is a range of the timeline of at most about so many rows; where the session's partitions are more, there are as many.
CHUNK_ROWS = 4_000_000
#: An entity's events are built into trees so many at a time.
PIECE = 1 << 16
_NO_GAP = np.iinfo(np.int64).max
_SCHEMA = (
    "entity string, start_us bigint, end_us bigint, n_events bigint, gap_us bigint, parent_gap_us bigint, chunk bigint"
)


def _tree(atoms: list[tuple], emit: list[tuple]) -> tuple:
    """Append every inner node below the root of a run of atoms (start, end, n, height) to ``emit``; return the root."""
    stack: list[tuple] = []
    left = _NO_GAP
    last = len(atoms) - 1
    for i, (start, end, n, height) in enumerate(atoms):
        right = atoms[i + 1][0] - end if i < last else _NO_GAP
        while stack and right >= left:
            if height < left:
                emit.append((start, end, n, height, left))
            p_start, p_end, p_n, p_height, p_left = stack.pop()
            if p_height < left:
                emit.append((p_start, p_end, p_n, p_height, left))
            start, n, height, left = p_start, p_n + n, left, p_left
        stack.append((start, end, n, height, left))
        left = right
    return stack[0][:4]


def _skeleton(atoms: list[tuple], left_open: bool, right_open: bool, emit: list[tuple]) -> list[tuple]:
    """Close what lies between the record gaps and return one atom for each stretch between them."""
    if len(atoms) == 1:
        return atoms
    gaps = np.array([b[0] - a[1] for a, b in zip(atoms, atoms[1:])], dtype=np.int64)
    record = np.zeros(len(gaps), dtype=bool)
    if left_open:
        record |= gaps > np.concatenate([[-1], np.maximum.accumulate(gaps)[:-1]])
    if right_open:
        back = gaps[::-1]
        record |= (back > np.concatenate([[-1], np.maximum.accumulate(back)[:-1]]))[::-1]
    cuts = [0, *(np.flatnonzero(record) + 1).tolist(), len(atoms)]
    return [_tree(atoms[a:b], emit) for a, b in zip(cuts, cuts[1:])]


def _wanted(table: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Which closed nodes (start, end, n, height, parent) are a session at a wanted threshold."""
    if wanted is None:
        return np.ones(len(table), dtype=bool)
    low = np.searchsorted(wanted, table[:, 3], side="left")
    return (low < len(wanted)) & (wanted[np.minimum(low, len(wanted) - 1)] < table[:, 4])


class _Out:
    """Output rows of many entities, gathered into batches of some size."""

    def __init__(self, wanted: np.ndarray | None):
        self.wanted = wanted
        self.nodes: list[tuple] = []
        self.owners: list[tuple[str, int]] = []

    def close(self, entity: str, before: int) -> None:
        self.owners.append((entity, len(self.nodes) - before))

    def batch(self, chunk: int | None = None) -> pa.RecordBatch:
        table = np.array(self.nodes, dtype=np.int64).reshape(-1, 5)
        owner = np.repeat(np.arange(len(self.owners)), [n for _, n in self.owners])
        names = pa.array([name for name, _ in self.owners], pa.string())
        if chunk is None:
            kept = _wanted(table, self.wanted)
            table, owner = table[kept], owner[kept]
        self.nodes, self.owners = [], []
        parent = pa.array(table[:, 4], pa.int64(), mask=table[:, 4] == _NO_GAP)
        at = pa.array([chunk] * len(table), pa.int64())
        columns = [names.take(pa.array(owner, pa.int64())), *(pa.array(table[:, k]) for k in range(4)), parent, at]
        return pa.RecordBatch.from_arrays(columns, ["entity", "start_us", "end_us", "n_events", "gap_us", "parent_gap_us", "chunk"])


class _Run:
    """The atoms of the entity that a chunk is at. When they are many, what no later event can change is closed."""

    def __init__(self, entity: str, first: bool):
        self.entity, self.first = entity, first
        self.atoms: list[tuple] = []
        self.limit = PIECE

    def add(self, times: np.ndarray, counts: np.ndarray, out: _Out) -> None:
        for at in range(0, len(times), PIECE):
            self.atoms += [(t, t, n, 0) for t, n in zip(times[at : at + PIECE].tolist(), counts[at : at + PIECE].tolist())]
            if len(self.atoms) > self.limit:
                before = len(out.nodes)
                self.atoms = _skeleton(self.atoms, True, True, out.nodes)
                out.close(self.entity, before)
                self.limit = max(PIECE, 2 * len(self.atoms))

    def end(self, last: bool, out: _Out, spine: _Out) -> None:
        before = len(out.nodes)
        if self.first or last:
            open_ = _skeleton(self.atoms, self.first, last, out.nodes)
            spine.nodes += [(*x, _NO_GAP) for x in open_]
            spine.close(self.entity, len(spine.nodes) - len(open_))
        else:
            out.nodes.append((*_tree(self.atoms, out.nodes), _NO_GAP))
        out.close(self.entity, before)


def _chunk_trees(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, spine = _Out(wanted), _Out(wanted)
        at: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("entity").dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy()
            time, count = batch.column("t").to_numpy(), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(cuts, cuts[1:]):
                entity = names[int(code[a])].as_py()
                if at is None or at.entity != entity:
                    if at is not None:
                        at.end(False, out, spine)
                    at = _Run(entity, at is None)
                at.add(time[a:b], count[a:b], out)
                if len(out.nodes) >= PIECE:
                    yield out.batch()
        if at is not None:
            at.end(True, out, spine)
            yield out.batch()
            yield spine.batch(TaskContext.get().partitionId())

    return run


def _merge(wanted: np.ndarray | None, span: int, final: bool):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("start_us")
        atoms = list(zip(*(part.column(c).to_pylist() for c in ("start_us", "end_us", "n_events", "gap_us"))))
        entity = part.column("entity")[0].as_py()
        out, spine = _Out(wanted), _Out(wanted)
        if final:
            out.nodes.append((*_tree(atoms, out.nodes), _NO_GAP))
        else:
            spine.nodes += [(*x, _NO_GAP) for x in _skeleton(atoms, True, True, out.nodes)]
        out.close(entity, 0)
        spine.close(entity, 0)
        return pa.Table.from_batches([out.batch(), spine.batch(part.column("chunk")[0].as_py() // span)])

    return run


def gap_tree(events: DataFrame, entity: Column, time_us: Column, item: Column, gaps_us: Sequence[int] | None = None) -> DataFrame:
    """Cartesian tree over each entity's gaps: entity, start_us, end_us, n_events, gap_us, parent_gap_us.

    ``events`` may hold any further columns, whatever their names; only the three expressions are read. Rows with a null
    entity, time or item do not count, and rows equal in all three are one event. Events of one entity at one instant form
    a single leaf of height 0 that counts each of them, so ties need no order. With ``gaps_us`` only the nodes that are a
    session at one of these thresholds are returned, else all. No events give no rows.
    """
    wanted = None if gaps_us is None else np.array(sorted(gaps_us), dtype=np.int64)
    rows = events.select(entity.cast("string").alias("entity"), time_us.cast("bigint").alias("t"), item.cast("string").alias("item"))
    rows = rows.dropna()
    # the groupings follow the range partitioning, so this is the only shuffle of the events
    n_chunks = -(-events.count() // CHUNK_ROWS)
    more = n_chunks > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n_chunks, "entity", "t") if more else rows.repartitionByRange("entity", "t")
    leaves = ranges.dropDuplicates(["entity", "t", "item"]).groupBy("entity", "t")
    leaves = leaves.agg(F.count("*").alias("n")).sortWithinPartitions("entity", "t")
    stage = materialize(leaves.mapInArrow(_chunk_trees(wanted), _SCHEMA), "gap-tree")
    closed, atoms = [stage.filter("chunk is null")], stage.filter("chunk is not null")
    chunks = 1 + (atoms.agg(F.max("chunk")).first()[0] or 0)
    while True:
        final = chunks <= FAN_IN
        group = [F.col("entity")] if final else [F.col("entity"), F.floor(F.col("chunk") / FAN_IN).alias("part")]
        merged = atoms.groupBy(*group).applyInArrow(_merge(wanted, FAN_IN, final), _SCHEMA)
        if final:
            closed.append(merged)
            break
        merged = materialize(merged, "gap-merge")
        closed.append(merged.filter("chunk is null"))
        atoms, chunks = merged.filter("chunk is not null"), -(-chunks // FAN_IN)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("chunk")


def sessions_at(tree: DataFrame, gap_us: int) -> DataFrame:
    """The sessions of one threshold: a gap longer than ``gap_us`` splits, one of exactly ``gap_us`` does not."""
    cut = (F.col("gap_us") <= gap_us) & (F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > gap_us))
    return tree.filter(cut).select(
        "entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events"
    )
