"""The one-round join: rows go to the cells of a HyperCube and every cell is joined by itself."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Collection, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyfold.operators.leapfrog import leapfrog, variable_column
from manyfold.plans.graph import QueryGraph
from manyfold.plans.query import MultiJoin, collated, key_type, normal, ref

CELL = "__cell"


def routed(query: MultiJoin, graph: QueryGraph, name: str, shares: Sequence[int], with_keys: bool = False) -> DataFrame:
    """The relation with its cells: one row for each combination of the shares of the variables that it lacks.

    Cells are numbered row-major. The coordinate of a variable is the hash of the key, cast to the type that all
    columns of the variable share, modulo the variable's share; null keys can't match and are left out before. with_keys
    adds each variable of the relation in a form in which equal keys are equal bytes.
    """
    base, offsets, extra = _placed(query, graph, name, shares, with_keys)
    cell = F.explode(F.array(*((base + k).cast("int") for k in offsets))) if len(offsets) > 1 else base.cast("int")
    return query.prepared(name, {CELL: cell, **extra})


def _placed(query: MultiJoin, graph: QueryGraph, name: str, shares: Sequence[int], with_keys: bool = False) -> tuple[Column, list[int], dict[str, Column]]:
    """A row's first cell, the offsets of its others from there (0 among them), and the keys of its variables."""
    extra = {}
    factors = [math.prod(shares[v + 1 :]) for v in range(len(shares))]
    base, missing = F.lit(0), []
    for v, members in enumerate(graph.classes):
        own = next((m for m in members if m[0] == name), None)
        kind = key_type(query.type_of(m) for m in members)
        if own is not None and with_keys:
            extra[variable_column(v)] = normal(ref(own), kind)
        if shares[v] == 1:
            continue
        if own is None:
            missing.append([k * factors[v] for k in range(shares[v])])
        else:
            base = base + F.pmod(F.xxhash64(normal(ref(own), kind)), F.lit(shares[v])).cast("int") * factors[v]
    return base, [sum(p) for p in itertools.product(*missing)], extra


def largest_cell(query: MultiJoin, shares: Sequence[int], enough: int) -> int:
    """Rows of the fullest cell, counted before rows are copied to their cells. Relations are counted until a cell has more
    than enough."""
    graph, cells = query.graph(), np.zeros(math.prod(shares), np.int64)
    for name in query.relations:
        base, offsets, _ = _placed(query, graph, name, shares)
        found = query.prepared(name, {CELL: base.cast("int")}).groupBy(CELL).count().collect()
        for first, n in found:
            cells[first + np.array(offsets)] += n
        if cells.max(initial=0) > enough:
            break
    return int(cells.max(initial=0))


def fullest_part(query: MultiJoin, shares: Sequence[int], name: str) -> int:
    """Rows of one relation in the cell that gets most of them."""
    base, _, _ = _placed(query, query.graph(), name, shares)
    found = query.prepared(name, {CELL: base.cast("int")}).groupBy(CELL).count().agg(F.max("count")).first()[0]
    return found or 0


def routable(query: MultiJoin, graph: QueryGraph) -> list[int]:
    """Variables that can be dealt by hash: all their columns have one key type, of more than two values, whose equal keys
    have equal bytes."""
    kinds = [key_type(query.type_of(m) for m in members) for members in graph.classes]
    return [v for v, kind in enumerate(kinds) if kind is not None and not isinstance(kind, T.BooleanType) and not collated(kind)]


def comparable_bytes(query: MultiJoin, graph: QueryGraph) -> bool:
    """Whether keys of every variable can be brought into a form in which equal ones have equal bytes."""
    kinds = [key_type(query.type_of(m) for m in members) for members in graph.classes]
    return all(kind is not None and not collated(kind) for kind in kinds)


def one_round(query: MultiJoin, shares: Sequence[int], local: str = "joins", variable_order: Sequence[int] | None = None, order: Sequence[str] | None = None, sieve: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None, hashed: Collection[str] = ()) -> DataFrame:
    """local: "joins" (a chain of Spark's joins within the cells, in the order given; spills) or "leapfrog" (variable by variable in Arrow
    tables, without large intermediate results; a cell has to fit into a task's memory). Keys under a collation are
    joined by Spark's joins in either case. sieve: filters the chain's rows after each join. hashed: relations whose part of a
    cell is hashed in memory when it meets the chain's rows, so that these aren't sorted and don't spill.

    Every cell is a partition of its own. Joins on (cell, key) stay in place, for which the session setting
    spark.sql.requireAllClusterKeysForCoPartition is switched off.
    """
    graph = query.graph()
    shares = [s if v in routable(query, graph) else 1 for v, s in enumerate(shares)]
    cells = math.prod(shares)
    spark = next(iter(query.relations.values())).sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    if local == "leapfrog" and comparable_bytes(query, graph):
        parts = {r: routed(query, graph, r, shares, with_keys=True) for r in query.relations}
        return query.finish(leapfrog(graph, parts, CELL, cells, variable_order))
    parts = {r: routed(query, graph, r, shares) for r in query.relations}
    dealt = {r: df.repartitionById(cells, F.col(CELL)).alias(r) for r, df in parts.items()}
    order = list(order or most_conditions(graph))
    joined, done = dealt[order[0]], [order[0]]
    for r in order[1:]:
        condition = F.col(f"`{order[0]}`.`{CELL}`") == F.col(f"`{r}`.`{CELL}`")
        for c in query.conditions(done, r, graph):
            condition = condition & c
        joined = joined.join(dealt[r].hint("shuffle_hash") if r in hashed else dealt[r], condition)
        done.append(r)
        joined = sieve(joined, done) if sieve else joined
    return query.finish(joined)


def connected_order(graph: QueryGraph, start: str | None = None) -> list[str]:
    """Breadth first from a relation with one neighbour (else the first), so that every next one shares a variable."""
    near = graph.neighbours()
    out: list[str] = []
    for part in graph.parts():
        first = start if start in part else next((r for r in part if len(near[r]) == 1), part[0])
        seen, todo = {first}, [first]
        while todo:
            r = todo.pop(0)
            out.append(r)
            for s in part:
                if s in near[r] and s not in seen:
                    seen.add(s)
                    todo.append(s)
    return out


def most_conditions(graph: QueryGraph, start: str | None = None, rows: Mapping[str, int] | None = None) -> list[str]:
    """From the same start, next is always the relation with the most variables among those joined already, so that cycles
    close early; of several, the smallest, then the first in breadth-first order."""
    near = connected_order(graph, start)
    out: list[str] = []
    for part in graph.parts():
        left = [r for r in near if r in part]
        out.append(left.pop(0))
        while left:
            held = frozenset().union(*(graph.of[r] for r in out if r in part))
            best = max(left, key=lambda r: (len(graph.of[r] & held), -(rows or {}).get(r, 0), -near.index(r)))
            left.remove(best)
            out.append(best)
    return out
