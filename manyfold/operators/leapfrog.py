"""A worst-case optimal join within cells: one variable at a time, over sorted tries, on whole columns at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyfold.plans.graph import QueryGraph


class Trie:
    """Rows sorted by their codes; level k holds the distinct prefixes of length k + 1, each with its parent."""

    def __init__(self, codes: Sequence[np.ndarray], rows: int):
        self.order = np.lexsort(tuple(reversed(codes))) if codes else np.arange(rows)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # values, first child of each parent (+ end)
        self.keys: dict[int, np.ndarray] = {}  # of a level: parent and value in one number
        self.starts = np.array([0, rows])  # rows of each node of the last level (+ end)
        new = np.zeros(rows, bool)
        new[:1] = True
        parents = np.zeros(rows, np.int64)
        count = 1
        for c in codes:
            c = c[self.order]
            new = new.copy()
            new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            self.levels.append((c[first], np.searchsorted(parents[first], np.arange(count + 1))))
            parents = np.cumsum(new) - 1
            count = len(first)
            self.starts = np.append(first, rows)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, child = self.levels[level]
        return child[nodes], child[nodes + 1]

    def seek(self, level: int, nodes: np.ndarray, values: np.ndarray, domain: int) -> np.ndarray:
        """The child with the value of each node, or -1."""
        if level not in self.keys:
            have, child = self.levels[level]
            self.keys[level] = np.repeat(np.arange(len(child) - 1), np.diff(child)) * domain + have
        keys = self.keys[level]
        wanted = nodes * domain + values
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(len(keys) and keys[at] == wanted, at, -1) if len(keys) else np.full(len(nodes), -1)


#: Bindings, or rows of the join, that are held at once.
BLOCK = 1 << 19
#: Rows of the join that are handed on at once.
BATCH = 1 << 16


def matches(keys: Mapping[str, Mapping[int, np.ndarray]], rows: Mapping[str, int], order: Sequence[int]) -> dict[str, np.ndarray]:
    """Row numbers of each relation for every row of the join."""
    blocks = list(matches_by_block(keys, rows, order))
    return {r: np.concatenate([b[r] for b in blocks] or [np.zeros(0, np.int64)]) for r in keys}


def matches_by_block(keys: Mapping[str, Mapping[int, np.ndarray]], rows: Mapping[str, int], order: Sequence[int], block: int = BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """The same, some rows at a time: candidates for a variable are tried in blocks, and a block is followed through to rows
    before the next one, so that what is held grows with the number of variables only. One binding's candidates, or rows,
    stay together.

    keys[r][v]: codes of variable v in relation r. A variable's values come from the relation with the fewest below
    the present bindings, and the others are searched for them.
    """
    mine = {r: [v for v in order if v in keys[r]] for r in keys}
    tries = {r: Trie([keys[r][v] for v in mine[r]], rows[r]) for r in keys}
    domains = {v: int(max(max((k[v].max(initial=-1) for k in keys.values() if v in k), default=0), 0)) + 1 for v in order}

    def bind(depth: int, at: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        if depth == len(order):
            yield from expand(at)
            return
        v = order[depth]
        holders = [r for r in keys if v in keys[r]]
        level = {r: mine[r].index(v) for r in holders}
        spans = {r: tries[r].children(level[r], at[r]) for r in holders}
        width = np.stack([spans[r][1] - spans[r][0] for r in holders])
        for part in _blocks(width.min(0), block):
            least = width[:, part].argmin(0)
            chosen: list[tuple[np.ndarray, np.ndarray]] = []
            for k, r in enumerate(holders):
                use = part[least == k]
                size = width[k][use]
                binding = np.repeat(use, size)
                node = np.repeat(spans[r][0][use] - np.cumsum(size) + size, size) + np.arange(size.sum())
                chosen.append((binding, tries[r].levels[level[r]][0][node]))
            binding, values = np.concatenate([c[0] for c in chosen]), np.concatenate([c[1] for c in chosen])
            found = {}
            for r in holders:  # those that fail are not looked for again
                place = tries[r].seek(level[r], at[r][binding], values, domains[v])
                good = place >= 0
                binding, values, found = binding[good], values[good], {s: x[good] for s, x in found.items()} | {r: place[good]}
            if len(binding):
                yield from bind(depth + 1, {r: found[r] if r in found else at[r][binding] for r in keys})

    def expand(at: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        sizes = {r: trie.starts[at[r] + 1] - trie.starts[at[r]] for r, trie in tries.items()}
        for picked in _blocks(np.prod(np.stack([s.astype(float) for s in sizes.values()]), axis=0), block):
            out: dict[str, np.ndarray] = {}
            for r, trie in tries.items():
                node, size = at[r][picked], sizes[r][picked]
                row = np.repeat(trie.starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
                again = np.repeat(np.arange(len(picked)), size)
                picked = picked[again]
                out = {s: x[again] for s, x in out.items()}
                out[r] = trie.order[row]
            yield out

    if all(rows.values()):
        yield from bind(0, {r: np.zeros(1, np.int64) for r in keys})


def _blocks(sizes: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Places of sizes above 0, in order, cut where their sum passes a multiple of the block."""
    places = np.flatnonzero(sizes)
    if len(places):
        number = np.cumsum(sizes[places]) // block
        yield from np.split(places, np.flatnonzero(np.diff(number)) + 1)


def variable_column(v: int) -> str:
    return f"__variable{v}"


def leapfrog(graph: QueryGraph, parts: Mapping[str, DataFrame], cell: str, cells: int, variable_order: Sequence[int] | None = None) -> DataFrame:
    """The relations' rows of each cell, one struct column per relation, joined cell by cell.

    Parts hold, beside their columns and the cell, their variables as variable_column names them; these are compared by
    their bytes. The order of variables is a path through the query graph where none is given.
    """
    names = list(parts)
    own_columns = {r: [f for f in df.schema.fields if f.name != cell] for r, df in parts.items()}
    structs = {r: T.StructType(fields) for r, fields in own_columns.items()}
    tagged = []
    for k, r in enumerate(names):
        columns = [F.struct(*(F.col(f"`{r}`.`{f.name}`") for f in structs[r])).alias(s) if s == r else F.lit(None).cast(structs[s]).alias(s) for s in names]
        tagged.append(parts[r].select(F.col(f"`{r}`.`{cell}`").alias(cell), F.lit(k).alias("__of"), *columns))
    rows = reduce(DataFrame.unionAll, tagged).repartitionById(cells, F.col(cell))
    order = list(variable_order or graph.variable_path())
    holders = {v: [r for r in names if v in graph.of[r]] for v in range(len(graph.classes))}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        of = table.column("__of").to_numpy()
        held = {r: table.column(r).take(pa.array(np.flatnonzero(of == k))) for k, r in enumerate(names)}
        del table
        held = {r: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for r, x in held.items()}
        held = {r: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for r, x in held.items()}
        keys: dict[str, dict[int, np.ndarray]] = {r: {} for r in names}
        for v, held_by in holders.items():
            arrays = [pa.compute.struct_field(held[r], variable_column(v)) for r in held_by]
            codes = pa.concat_arrays(arrays).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum([len(a) for a in arrays])
            for r, lo, hi in zip(held_by, ends - [len(a) for a in arrays], ends, strict=True):
                keys[r][v] = codes[lo:hi].astype(np.int64)
        for picked in matches_by_block(keys, {r: len(x) for r, x in held.items()}, order):
            for k in range(0, len(picked[names[0]]), BATCH):
                yield pa.RecordBatch.from_arrays([held[r].take(pa.array(picked[r][k : k + BATCH])) for r in names], names)

    schema = T.StructType([T.StructField(r, structs[r]) for r in names])
    return rows.groupBy(cell).applyInArrow(within, schema)
