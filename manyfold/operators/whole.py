"""A worst-case optimal join by whole relations: pairs of the first two variables are dealt out, and every worker holds the
keys of each distinct relation once, as sorted lists of neighbours. Nothing is copied to cells, and no intermediate result is sent."""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyfold.operators.leapfrog import _blocks
from manyfold.plans.graph import QueryGraph
from manyfold.plans.query import MultiJoin, key_type, ref

#: Candidates that are tried at once, and rows that are handed on at once.
BLOCK, BATCH = 1 << 19, 1 << 16
#: Slots of the table in which a block's keys are marked before they are searched for.
SLOTS = 1 << 22
#: Pairs that are dealt together.
RUN = 1 << 12


@dataclass
class Lists:
    """The pairs (x, y) of a relation, each once: node k has the value values[k], the neighbours ys[start[k]:start[k] + size[k]]
    in order, and copies of each, or None where all are 1. A relation of one variable has its values as both columns."""

    values: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ys: np.ndarray
    copies: np.ndarray | None

    @classmethod
    def build(cls, parts: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> Lists:
        """Of parts that are each sorted by x and y; all rows of an x are in one part."""
        ys, at = np.empty(rows, np.int32), 0
        values, starts, sizes, copies = [], [], [], []
        for x, y in parts:
            if not len(x):
                continue
            if ys.dtype == np.int32 and max(abs(int(y.min())), abs(int(y.max()))) >= 1 << 31:
                ys = ys.astype(np.int64)
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            kept = np.flatnonzero(new)
            copies.append(np.diff(np.append(kept, len(x))).astype(np.int32) if len(kept) < len(x) else len(kept))
            if len(kept) < len(x):
                x, y = x[kept], y[kept]
            del kept, new
            ys[at : at + len(y)] = y
            first = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
            values.append(x[first])
            starts.append(first + at)
            sizes.append(np.diff(np.append(first, len(x))))
            at += len(x)
        join = lambda found: np.concatenate(found) if found else np.zeros(0, np.int64)
        many = any(not isinstance(c, int) for c in copies)
        values, starts, sizes = join(values), join(starts), join(sizes)
        order = np.argsort(values)
        return cls(values[order], starts[order], sizes[order], ys[:at], join([np.ones(c, np.int32) if isinstance(c, int) else c for c in copies]) if many else None)

    def nodes(self, values: np.ndarray) -> np.ndarray:
        """The node of each value, or -1."""
        if not hasattr(self, "_node_of"):
            low, high = (int(self.values[0]), int(self.values[-1])) if len(self.values) else (0, -1)
            self._low, self._node_of = low, None
            if high - low < 8 * len(self.values) + 1000:  # dense enough to look up
                self._node_of = np.full(high - low + 2, -1, np.int32)
                self._node_of[self.values - low] = np.arange(len(self.values))
        if self._node_of is not None:
            place = values.astype(np.int64) - self._low
            return self._node_of[np.where((place < 0) | (place >= len(self._node_of)), len(self._node_of) - 1, place)]
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, at, -1)

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of each node, one list after the other, and of which place in nodes each is one."""
        size = self.size[nodes]
        of = np.repeat(np.arange(len(nodes)), size)
        return self.ys[np.repeat(self.start[nodes] - np.cumsum(size) + size, size) + np.arange(len(of))], of

    def search(self, nodes: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """The place of y among its node's neighbours, in ys, or -1."""
        low = self.start[nodes]
        end = high = low + self.size[nodes]
        while (low < high).any():
            middle = (low + high) >> 1
            less = (low < high) & (self.ys[np.minimum(middle, len(self.ys) - 1)] < ys)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        return np.where((low < end) & (self.ys[np.minimum(low, len(self.ys) - 1)] == ys), low, -1) if len(low) else low


def _slot(of: np.ndarray, ys: np.ndarray) -> np.ndarray:
    return (of.astype(np.uint32) * np.uint32(0x9E3779B1) + ys.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOTS.bit_length() + 1)


def joined(lists: dict[int, Lists], relations: Sequence[tuple[int, int, int]], n: int, part: int, parts: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bindings of variables 0 to n - 1 (rows of a matrix) in the order of binding, and how often each occurs, some at a
    time; only pairs of the first two variables dealt to this part. relations: which lists, first variable, second variable
    (bound later, or the first again)."""
    lead = next(k for k, (_, x, y) in enumerate(relations) if (x, y) == (0, 1))
    marked = np.zeros(SLOTS, bool)

    def times(lists_: Lists, place: np.ndarray, copies: np.ndarray) -> np.ndarray:
        return copies if lists_.copies is None else copies * lists_.copies[place]

    def confirmed(v: int, bound: list[np.ndarray], copies: np.ndarray, at: dict[int, np.ndarray], but: int | None) -> tuple[list[np.ndarray], np.ndarray, dict[int, np.ndarray]]:
        """Bindings, v the last bound, that all relations over v and variables before allow. at: nodes of relations of
        which the first variable is bound."""

        def keep(good):
            return [b[good] for b in bound], copies[good], {r: a[good] for r, a in at.items()}

        for r, (own, x, y) in enumerate(relations):
            if y == v and r != but and x != y and r in at:
                place = lists[own].search(at[r], bound[v])
                good = np.flatnonzero(place >= 0)
                bound, copies, at = keep(good)
                copies = times(lists[own], place[good], copies)
        for r, (own, x, y) in enumerate(relations):
            if x == v and r not in at:
                node = next((at[s] for s in at if relations[s][:2] == (own, x)), None)
                if node is None:
                    node = lists[own].nodes(bound[v]) if len(lists[own].values) else np.full(len(copies), -1)
                    good = np.flatnonzero(node >= 0)
                    bound, copies, at = keep(good)
                    node = node[good]
                at[r] = node
                if x == y:
                    copies = times(lists[own], lists[own].start[node], copies)
        return bound, copies, at

    def bind(v: int, bound: list[np.ndarray], copies: np.ndarray, at: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(copies):
            return
        if v == n:
            yield np.stack(bound), copies
            return
        holders = [r for r, (_, x, y) in enumerate(relations) if y == v and x < v]
        width = np.stack([lists[relations[r][0]].size[at[r]] for r in holders])
        least = width.argmin(0)
        for some in _blocks(width.min(0), block):
            found = []
            for k, r in enumerate(holders):
                use = some[least[some] == k]
                if not len(use):
                    continue
                mine = lists[relations[r][0]]
                values, of = mine.neighbours(at[r][use])
                for s in holders:  # most fail: keys of the others are marked in a table, and only what hits it is searched for
                    if s == r or not len(values):
                        continue
                    other = lists[relations[s][0]]
                    new = np.append(True, at[s][use][1:] != at[s][use][:-1])
                    number = np.cumsum(new)
                    if other.size[at[s][use][new]].sum() > 2 * len(values):  # too many to mark
                        continue
                    held, whose = other.neighbours(at[s][use][new])
                    slots = _slot(whose + 1, held)
                    marked[slots] = True
                    hit = np.flatnonzero(marked[_slot(number[of], values)])
                    marked[slots] = False
                    values, of = values[hit], of[hit]
                use = use[of]
                more = copies[use]
                if mine.copies is not None:
                    more = more * mine.copies[mine.search(at[r][use], values)]
                found.append(confirmed(v, [*(b[use] for b in bound), values], more, {q: a[use] for q, a in at.items()}, r))
            yield from bind(v + 1, *_put_together(found, v + 1))

    own = lists[relations[lead][0]]
    by_start = np.argsort(own.start)
    for first in range(part * RUN, len(own.ys), parts * RUN):
        places = np.arange(first, min(first + RUN, len(own.ys)))
        node = by_start[np.searchsorted(own.start[by_start], places, side="right") - 1]
        bound, copies, at = confirmed(0, [own.values[node], own.ys[places]], times(own, places, np.ones(len(places), np.int64)), {lead: node}, None)
        yield from bind(2, *confirmed(1, bound, copies, at, lead))


def _put_together(found: list, width: int) -> tuple[list[np.ndarray], np.ndarray, dict[int, np.ndarray]]:
    if len(found) == 1:
        return found[0]
    return [np.concatenate([f[0][v] for f in found]) for v in range(width)], np.concatenate([f[1] for f in found]), {r: np.concatenate([f[2][r] for f in found]) for r in found[0][2]}


@dataclass
class Shape:
    """order: variables as they are bound. sources: distinct relations with their two columns. relations: for each, which
    source, and the places of its variables in the order."""

    order: list[int]
    sources: list[DataFrame]
    relations: list[tuple[int, int, int]]
    rows: list[str]  # of each source, the relation that it was taken from


def shape(query: MultiJoin, graph: QueryGraph, order: Sequence[int]) -> Shape | None:
    """How the query is joined by whole relations: all are joined by whole numbers, one or two variables each, and nothing
    else of them is read. None where it isn't of that kind. The order is changed where fewer distinct sources come of it."""
    kinds = [key_type(query.type_of(m) for m in members) for members in graph.classes]
    keys = {m for members in graph.classes for m in members}
    if len(graph.parts()) > 1 or len(order) < 2 or not all(isinstance(kind, T.LongType) for kind in kinds):
        return None
    if any(not 1 <= len(graph.of[r]) <= 2 or any((r, c) not in keys and query.reads(r, c) for c in query.relations[r].columns) for r in graph.relations):
        return None
    column = {(r, v): next(m[1] for m in graph.classes[v] if m[0] == r) for r in graph.relations for v in graph.of[r]}
    alike: list[str] = []  # the first of the relations over equal inputs
    same: dict[str, int] = {}
    for r in graph.relations:
        mine = query.relations[r]
        same[r] = next((k for k, s in enumerate(alike) if not query.local.get(r) and not query.local.get(s) and mine.columns == query.relations[s].columns and (mine is query.relations[s] or mine.sameSemantics(query.relations[s]))), len(alike))
        if same[r] == len(alike):
            alike.append(r)

    def taken(order: Sequence[int]) -> dict[str, tuple[int, tuple[str, ...]]]:
        return {r: (same[r], tuple(column[r, v] for v in order if v in graph.of[r])) for r in graph.relations}

    def connected(order: Sequence[int]) -> bool:
        return all(any(v in graph.of[r] and graph.of[r] & set(order[:k]) for r in graph.relations) for k, v in enumerate(order) if k)

    tries = [o for o in (itertools.permutations(order) if len(order) <= 6 else [tuple(order)]) if connected(o)]
    if not tries:
        return None
    order = list(min(tries, key=lambda o: len(set(taken(o).values()))))
    of = taken(order)
    kept = list(dict.fromkeys(of.values()))
    names = [next(r for r in graph.relations if of[r] == k) for k in kept]
    sources = [query.prepared(r).select(*(ref((r, c)).cast("long").alias(n) for c, n in zip((of[r][1] * 2)[:2], "xy", strict=True))) for r in names]
    places = {r: [k for k, v in enumerate(order) if v in graph.of[r]] for r in graph.relations}
    return Shape(order, sources, [(kept.index(of[r]), places[r][0], places[r][-1]) for r in graph.relations], names)


def narrow(source: DataFrame) -> bool:
    """Whether all keys fit into four bytes."""
    low, high = source.agg(F.min(F.least("x", "y")), F.max(F.greatest("x", "y"))).first()
    return low is None or -(1 << 31) < low and high < 1 << 31


#: Folders written by this process; they go when it ends.
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110 - the session has ended before
            pass


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir), if there is one that Arrow can read too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    try:
        pyarrow.fs.FileSystem.from_uri(base if "://" in base else f"file://{base.removeprefix('file:')}")
    except Exception:  # noqa: BLE001 - unset, or a store that only Spark can read
        return None
    return base.rstrip("/")


#: The lists that this worker holds, of the last join.
_held: dict[tuple[str, ...], dict[int, Lists]] = {}


def _lists(paths: tuple[str, ...]) -> dict[int, Lists]:
    if paths not in _held:
        _held.clear()
        _held[paths] = {k: _read(path) for k, path in enumerate(paths)}
    return _held[paths]


def _read(path: str) -> Lists:
    system, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    files = sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet"))
    rows = 0
    for f in files:
        with system.open_input_file(f) as opened:
            rows += pa.parquet.ParquetFile(opened).metadata.num_rows

    def parts():
        for f in files:
            with system.open_input_file(f) as opened:
                table = pa.parquet.ParquetFile(opened).read(use_threads=False)
            yield table.column("x").to_numpy(), table.column("y").to_numpy()
            del table
            pa.default_memory_pool().release_unused()

    return Lists.build(parts(), rows)


def whole(query: MultiJoin, graph: QueryGraph, found: Shape, folder: str) -> DataFrame:
    """The sources are written once, by x and y in order, into the shared folder; then every worker reads them whole."""
    spark = found.sources[0].sparkSession
    paths = []
    for df in found.sources:
        path = f"{folder}/manyfold/whole-{uuid.uuid4().hex}"
        _written.append((spark, path))
        # a window takes rows as they lie where these are dealt by x already
        place = F.row_number().over(Window.partitionBy("x").orderBy("y"))
        df.withColumn("place", place).filter("place > 0").select("x", "y").write.parquet(path)
        paths.append(path)
    paths, relations, n = tuple(paths), found.relations, len(found.order)
    parts = 4 * spark.sparkContext.defaultParallelism
    names = [f"v{v}" for v in found.order]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for bound, copies in joined(_lists(paths), relations, n, part, parts):
                    ends = np.cumsum(copies)
                    for k in range(0, ends[-1], BATCH):
                        row = np.searchsorted(ends, np.arange(k, min(k + BATCH, ends[-1])), side="right")
                        yield pa.RecordBatch.from_arrays([pa.array(b[row].astype(np.int64)) for b in bound], names)

    rows = spark.range(0, parts, 1, parts).mapInArrow(within, ", ".join(f"{c} long" for c in names))
    columns: dict[str, dict] = {r: {} for r in graph.relations}
    for v, members in enumerate(graph.classes):
        for r, c in members:
            columns[r][c] = F.col(f"v{v}").cast(query.type_of((r, c))).alias(c)
    structs = [F.struct(*(columns[r][c] for c in query.relations[r].columns if c in columns[r])).alias(r) for r in graph.relations]
    return query.finish(rows.select(*structs))
