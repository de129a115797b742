"""From a query to a DataFrame: Catalyst's own joins, one round for all, or a mix by join tree and cost."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.operators.binary import BROADCAST_LIMIT, broadcastable, estimated_bytes
from manyfold.operators.hypercube import connected_order, fullest_part, largest_cell, most_conditions, one_round, routable
from manyfold.operators.sieve import Sieves
from manyfold.operators.whole import Shape, narrow, shape, shared_folder, whole
from manyfold.plans.cost import IndependenceEstimator, SampleEstimator, SizeEstimator, cheapest_order, multi_round_bytes, one_round_bytes
from manyfold.plans.graph import JoinTree, QueryGraph, join_tree
from manyfold.plans.query import MultiJoin, ref
from manyfold.plans.shares import best_shares, load, rounded_shares, shuffled
from manyfold.plans.stats import RelationStats, collect_stats, derived, row_bytes

MODES = ("default", "one-round", "mixed", "core")


def left_deep(query: MultiJoin, start: str | None = None, hints: Mapping[str, str | int] | None = None, order: Sequence[str] | None = None, spread: bool = False, sieve: Sieves | None = None) -> DataFrame:
    """A chain of two-way joins in which every relation meets all its conditions with those before it.

    Without an order, next is the relation that meets most conditions. Relations without a common variable are
    cross-joined, as SQL asks. hints: relation -> Spark join hint; a broadcast is asked for only of a relation that Spark
    estimates within the limit of a broadcast on request. spread: two relations that Spark would shuffle although they fill
    less than a partition for each core don't go by their keys, as the rows that they multiply to would stay in these few
    partitions: the first is dealt out evenly and the second broadcast. sieve: filters the rows after each join.
    """
    graph = query.graph()
    order = list(order or most_conditions(graph, start))
    if spread and not hints and (parts := _small_pair(query, graph, order)):
        hints = {order[0]: parts, order[1]: "broadcast"}

    def part(r: str) -> DataFrame:
        df = query.prepared(r)
        if hints and isinstance(hints.get(r), int):
            return df.repartition(hints[r]).alias(r)
        if hints and r in hints and (hints[r] != "broadcast" or broadcastable(df)):
            return df.hint(hints[r])
        return df

    joined, done = part(order[0]), [order[0]]
    for r in order[1:]:
        conditions = query.conditions(done, r, graph)
        if conditions:
            whole = conditions[0]
            for c in conditions[1:]:
                whole = whole & c
            joined = joined.join(part(r), whole)
        else:
            joined = joined.crossJoin(part(r))
        done.append(r)
        joined = sieve(joined, done) if sieve else joined
    return query.finish(joined)


class OneRoundStrategy(Protocol):
    def shares(self, query: MultiJoin, graph: QueryGraph, stats: Mapping[str, RelationStats], cells: int) -> tuple[int, ...]: ...


class MultiRoundStrategy(Protocol):
    def order(self, query: MultiJoin, graph: QueryGraph, stats: Mapping[str, RelationStats]) -> list[str]: ...


class VariableOrder(Protocol):
    def order(self, graph: QueryGraph, stats: Mapping[str, RelationStats]) -> list[int]: ...


class _Shares:
    """Variables whose columns have no common key type get a share of 1."""

    def shares(self, query, graph, stats, cells):
        can = routable(query, graph)
        place = {v: k for k, v in enumerate(can)}
        of = {r: frozenset(place[v] for v in vs if v in place) for r, vs in graph.of.items()}
        found = self.pick({r: stats[r].rows for r in graph.relations}, of, len(can), cells)
        return tuple(found[place[v]] if v in place else 1 for v in range(len(graph.classes)))


class LowestLoad(_Shares):
    """Integer shares with the lowest load."""

    pick = staticmethod(best_shares)


class LinearProgram(_Shares):
    """The share linear program's solution, each share rounded down or up."""

    @staticmethod
    def pick(sizes, of, n_variables, cells):
        return rounded_shares(sizes, of, n_variables, cells) if n_variables else ()


class BreadthFirst:
    def order(self, query, graph, stats):
        return connected_order(graph)


class MostConditions:
    """The conditions that leave the fewest rows come first. Small relations alone are no reason: two of them may share a
    variable of few values only, so that joining them multiplies rows."""

    def order(self, query, graph, stats):
        return cheapest_order(query, graph, stats)


class ByPath:
    """Each variable shares a relation with the one before."""

    def order(self, graph, stats):
        return graph.variable_path()


class ByDistinct:
    """First the variable with the fewest distinct values of any of its columns, then always the one with which the fewest
    bindings of the variables so far are left, by estimate under independence: early levels of the tries stay small, and
    two variables that only a third one ties together don't come before it."""

    def order(self, graph, stats):
        of = {r: vs for r, vs in graph.of.items() if r in stats}
        distinct = {(r, v): max(min((stats[r].distinct.get(c) or math.inf for s, c in members if s == r), default=math.inf), 1) for v, members in enumerate(graph.classes) for r in of if v in of[r]}

        def bindings(chosen: list[int]) -> float:
            """Logarithm of the rows of the join of the relations' parts under the chosen variables."""
            rows = sum(math.log(min(max(stats[r].rows, 1), math.prod(distinct[r, v] for v in vs if v in chosen))) for r, vs in of.items() if vs & set(chosen))
            for v in chosen:
                rows -= sum(math.log(min(d, max(stats[r].rows, 1))) for r, d in sorted(((r, distinct[r, v]) for r in of if v in of[r]), key=lambda x: -x[1])[:-1])
            return rows

        out: list[int] = []
        left = list(range(len(graph.classes)))
        while left:
            out.append(min(left, key=lambda v: (bindings([*out, v]), v)))
            left.remove(out[-1])
        return out


#: Strategies by the names that session settings use.
SHARES = {"lowest-load": LowestLoad, "linear-program": LinearProgram}
ROUNDS = {"most-conditions": MostConditions, "breadth-first": BreadthFirst}
SIZES = {"independence": IndependenceEstimator, "sample": SampleEstimator}
VARIABLES = {"path": ByPath, "distinct": ByDistinct}

#: Spark joins shuffle partitions until one holds this much (spark.sql.adaptive.coalescePartitions.minPartitionSize).
SMALL = 1 << 20

#: (relation, its key columns) -> statistics that are there already, or None.
Known = Callable[[str, Sequence[str]], RelationStats | None]


@dataclass
class Planner:
    """cells: how many cells a one-round join has at most. bias: one round is chosen where the bytes that it sends times
    bias are below those of the multi-round plan. leapfrog_rows: rows that the largest cell may hold to be joined by
    leapfrog; with larger ones all are joined by Spark's joins, which spill. cell_rows: rows up to which cells joined by Spark's
    joins may grow, by average, where larger cells mean fewer copies. sieve_rows, sieve_least: chains test rows by Bloom
    filters of at most so many keys, where there are so many rows by estimate (operators/sieve.py). whole_rows, whole_least: a
    round over keys alone goes by whole relations (operators/whole.py) if these have at most so many rows and a chain's
    largest intermediate result has at least so many, by estimate, and four times theirs. hash_least: a relation that meets
    at least so many rows of a round, by estimate, and four times the inputs', is hashed within its cells (slower than a sort that has
    room). Small inputs whose chain makes whole_least rows are no round in mixed and core. decisions: what was chosen, for explaining. kept:
    derived relations that were cached for statistics and join; release() lets go of them."""

    mode: str = "default"
    cells: int = 100
    local: str = "joins"
    bias: float = 1.0
    one_round: OneRoundStrategy = field(default_factory=LowestLoad)
    multi_round: MultiRoundStrategy = field(default_factory=MostConditions)
    estimator: SizeEstimator = field(default_factory=IndependenceEstimator)
    variables: VariableOrder = field(default_factory=ByPath)
    leapfrog_rows: int = 1_000_000
    cell_rows: int = 5_000_000
    sieve_rows: int = 8_000_000
    sieve_least: int = 1_000_000
    whole_rows: int = 80_000_000
    whole_least: int = 10_000_000
    hash_least: int = 100_000_000
    sample_fraction: float = 0.01
    decisions: list[str] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def plan(self, query: MultiJoin, known: Known | None = None) -> DataFrame:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}; one of {', '.join(MODES)}")
        graph = query.graph()
        if self.mode == "default" or len(query.relations) < 3 or not query.equalities:
            if len(query.relations) > 2 and query.equalities and all(derived(df) for df in query.relations.values()):
                joined = self._by_whole(query, graph, self._statistics(query, graph, known))  # Catalyst knows no sizes here
                if joined is not None:
                    return joined
            self.decisions.append("multi-round: all")
            return left_deep(query, start=_largest(query), spread=True) if len(query.relations) > 2 else left_deep(query)
        if self.mode != "one-round" and self.bias >= 1:
            large = [r for r in query.relations if estimated_bytes(query.prepared(r)) > _broadcast_bytes(query)]
            if len(large) < 2:
                self.decisions.append("multi-round: all (every relation but one is small enough to broadcast, so nothing else is sent)")
                return left_deep(query, start=next(iter(large), None))
        stats = self._statistics(query, graph, known)
        if self.mode == "one-round":
            return query_round(self, query, graph, stats)
        near = most_conditions(graph, _largest(query))
        if self.bias >= 1 and self._most_rows(query, graph, stats, near) >= self.whole_least and _small_pair(query, graph, near):
            self.decisions.append("multi-round: all (the inputs fill less than a partition for each core and multiply rows: they are dealt out evenly and broadcast, so nothing else is sent)")
            return left_deep(query, order=near, spread=True)
        before = len(self.decisions)
        if self.mode == "core":
            joined = self._core(query, graph, stats)
        else:
            joined = query.finish(self._tree(query, graph, stats, join_tree(graph)))
        if not any(d.startswith("one-round") for d in self.decisions[before:]):
            return left_deep(query, order=self.multi_round.order(query, graph, stats), spread=True, sieve=self._sieves(query, graph, stats))  # no cycle is worth a round: one chain
        return joined

    def _sieves(self, query: MultiJoin, graph: QueryGraph, stats, plain: bool = True) -> Sieves:
        return Sieves(query, graph, stats, self.sieve_rows, self.sieve_least, plain)

    def release(self) -> None:
        """Lets go of what was cached; results that are still to be read compute it again."""
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def _statistics(self, query: MultiJoin, graph: QueryGraph, known: Known | None) -> dict[str, RelationStats]:
        """Statistics of the key columns, once for each distinct input, several at a time; derived inputs are cached, as
        both the statistics and the join read them."""
        keys = {r: [m[1] for c in graph.classes for m in c if m[0] == r] for r in query.relations}
        inputs: list[tuple[DataFrame, list[str]]] = []  # relations without predicates of their own over equal inputs
        stats: dict[str, RelationStats] = {}
        for r, df in query.relations.items():
            if query.local.get(r):
                inputs.append((query.prepared(r), [r]))
                continue
            plain = not any(c in query.hidden for c in keys[r])
            found = known(r, keys[r]) if known and plain else None
            if found is not None:
                stats[r] = found
                continue
            same = next((i for i in inputs if not query.local.get(i[1][0]) and i[0].columns == df.columns and i[0].semanticHash() == df.semanticHash() and i[0].sameSemantics(df)), None)
            if same:
                same[1].append(r)
            else:
                inputs.append((df, [r]))
        for df, _ in inputs:
            if derived(df):
                self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))

        def collect(item: tuple[DataFrame, list[str]]) -> RelationStats:
            df, names = item
            columns = [F.col(f"`{c}`") for c in dict.fromkeys(c for r in names for c in keys[r])]
            return collect_stats(df.select(*(columns or [F.lit(1).alias("one")])), self.sample_fraction)

        with ThreadPoolExecutor(4) as pool:
            for (_, names), found in zip(inputs, pool.map(collect, inputs), strict=True):
                stats.update(dict.fromkeys(names, found))
        return stats

    def _shares(self, query: MultiJoin, graph: QueryGraph, stats, local: str) -> tuple[int, ...]:
        """The strategy's shares; for Spark's joins, which spill, those of half the cells, a quarter and so on where they send
        fewer rows, down to two cells for each core."""
        cells, shares = self.cells, self.one_round.shares(query, graph, stats, self.cells)
        if local == "leapfrog":
            return shares
        sizes = {r: stats[r].rows for r in graph.relations}
        least = 2 * next(iter(query.relations.values())).sparkSession.sparkContext.defaultParallelism
        while (cells := cells // 2) >= least:
            fewer = self.one_round.shares(query, graph, stats, cells)
            if load(sizes, graph.of, fewer) > self.cell_rows:
                break
            if shuffled(sizes, graph.of, fewer) < shuffled(sizes, graph.of, shares):
                shares = fewer
        return shares

    def _most_rows(self, part: MultiJoin, graph: QueryGraph, stats, order: Sequence[str]) -> float:
        """Rows of a chain's largest intermediate result, by estimate."""
        return max((IndependenceEstimator().join_rows(part, graph, stats, order[:k]) for k in range(2, len(order))), default=0)

    def _whole(self, part: MultiJoin, graph: QueryGraph, stats) -> Shape | None:
        """How the relations are joined whole, where that's possible, they have room and a chain would make many more rows."""
        most = self._most_rows(part, graph, stats, self.multi_round.order(part, graph, stats))
        if most < self.whole_least or shared_folder(next(iter(part.relations.values())).sparkSession) is None:
            return None
        found = shape(part, graph, self.variables.order(graph, stats))
        if found is None or most < 4 * sum(stats[r].rows for r in found.rows):
            return None
        room = self.whole_rows
        if sum(stats[r].rows for r in found.rows) * 2 > room and any(not narrow(df) for df in found.sources):
            room //= 2  # eight bytes a key instead of four
        return found if sum(stats[r].rows for r in found.rows) <= room else None

    def _by_whole(self, part: MultiJoin, graph: QueryGraph, stats) -> DataFrame | None:
        """The relations joined whole, or None where they aren't."""
        if (found := self._whole(part, graph, stats)) is None:
            return None
        self.decisions.append(f"whole relations: {', '.join(graph.relations)} ({len(found.sources)} distinct)")
        joined = whole(part, graph, found, shared_folder(next(iter(part.relations.values())).sparkSession))
        written = [k for k in self.kept if any(k is r for r in part.relations.values())]
        for df in written:  # these aren't read again
            df.unpersist()
        self.kept = [k for k in self.kept if not any(k is df for df in written)]
        return joined

    def _joined_once(self, part: MultiJoin, graph: QueryGraph, stats, shares) -> DataFrame:
        """One round; by whole relations where that's possible and saves much; by leapfrog only where no cell holds more rows than a task has room for, as counted. Without a variable
        to deal by there would be one cell, so that's a chain of joins."""
        if not routable(part, graph):
            self.decisions.append(f"multi-round: {', '.join(graph.relations)} (no variable can be dealt to cells)")
            return left_deep(part, order=self.multi_round.order(part, graph, stats))
        joined = self._by_whole(part, graph, stats)
        if joined is not None:
            return joined
        local = self.local
        if local == "leapfrog" and (rows := largest_cell(part, shares, self.leapfrog_rows)) > self.leapfrog_rows:
            self.decisions.append(f"joins within cells: cells of up to {rows:.0f} rows are too large for leapfrog")
            large = [r for r in part.relations if estimated_bytes(part.prepared(r)) > _broadcast_bytes(part)]
            if len(large) < 2:  # dealt by keys of few values, the large one would stay in a few cells
                self.decisions.append("the large relation stays where it is and the others go to it by broadcast")
                return left_deep(part, start=next(iter(large), None))
            local, shares = "joins", self._shares(part, graph, stats, "joins")
        if local == "leapfrog":
            return one_round(part, shares, local, self.variables.order(graph, stats))
        order = self.multi_round.order(part, graph, stats)
        return one_round(part, shares, order=order, sieve=self._sieves(part, graph, stats, plain=False), hashed=self._hashed(part, graph, stats, shares, order))

    def _hashed(self, part: MultiJoin, graph: QueryGraph, stats, shares, order: Sequence[str]) -> list[str]:
        """Relations that meet so many of a round's intermediate rows, by estimate, that sorting these would fill the disk, and
        whose part of each cell, as counted, has room in memory."""
        out, inputs = [], sum(stats[r].rows for r in order)
        shares = [s if v in routable(part, graph) else 1 for v, s in enumerate(shares)]
        for k, r in enumerate(order[2:], 2):
            rows = IndependenceEstimator().join_rows(part, graph, stats, order[:k])
            if rows >= self.hash_least and rows >= 4 * inputs and fullest_part(part, shares, r) * row_bytes(part.prepared(r)) <= BROADCAST_LIMIT:
                out.append(r)
        if out:
            self.decisions.append(f"hashed within cells: {', '.join(out)}")
        return out

    def _core(self, query: MultiJoin, graph: QueryGraph, stats) -> DataFrame:
        """The cyclic core in one round if that is cheaper, then the branches in a chain."""
        core = graph.cyclic_core()
        rest = [r for r in connected_order(graph) if r not in core]
        if not core:
            self.decisions.append("multi-round: all (no cycle)")
            return left_deep(query, order=self.multi_round.order(query, graph, stats))
        joined = self._group(query, graph, stats, [JoinTree(r) for r in core])
        done = list(core)
        while rest:
            near = next((r for r in rest if query.conditions(done, r, graph)), rest[0])
            joined = self._two(query, graph, joined, done, query.prepared(near), [near])
            done.append(near)
            rest.remove(near)
        return query.finish(joined)

    def _tree(self, query: MultiJoin, graph: QueryGraph, stats, tree: JoinTree) -> DataFrame:
        if tree.relation:
            return query.prepared(tree.relation)
        if len(tree.children) == 2:
            left, right = tree.children
            return self._two(query, graph, self._tree(query, graph, stats, left), left.relations(), self._tree(query, graph, stats, right), right.relations())
        return self._group(query, graph, stats, list(tree.children))

    def _two(self, query, graph, left: DataFrame, in_left: Sequence[str], right: DataFrame, in_right: Sequence[str]) -> DataFrame:
        conditions = []
        for members in graph.classes:
            a = next((m for m in members if m[0] in in_left), None)
            b = next((m for m in members if m[0] in in_right), None)
            if a and b:
                conditions.append(ref(a) == ref(b))
        if not conditions:
            return left.crossJoin(right)
        whole = conditions[0]
        for c in conditions[1:]:
            whole = whole & c
        return left.join(right, whole)

    def _group(self, query: MultiJoin, graph: QueryGraph, stats, children: list[JoinTree]) -> DataFrame:
        """Three or more children: one round if they are leaves that close a cycle and it is cheaper, else a chain."""
        names = [c.relation for c in children if c.relation]
        inside = [c for c in graph.classes if len({m[0] for m in c if m[0] in names}) > 1]
        joins = sum(len({m[0] for m in c if m[0] in names}) - 1 for c in inside)
        if len(names) == len(children) and joins >= len(names):
            part = sub_query(query, names)
            sub = part.graph()
            shares = self._shares(part, sub, stats, self.local)
            width = {r: row_bytes(part.prepared(r)) for r in names}
            once = one_round_bytes(sub, stats, names, shares, width) * self.bias
            if (found := self._whole(part, sub, stats)) is not None:
                once = min(once, sum(stats[r].rows * width[r] for r in found.rows) * self.bias)
            more = multi_round_bytes(part, sub, stats, self.multi_round.order(part, sub, {r: stats[r] for r in names}), self.estimator, width, _broadcast_bytes(query), self._sieves(part, sub, stats).closing)
            self.decisions.append(f"{'one-round' if once < more else 'multi-round'}: {', '.join(names)} ({once:.0f} against {more:.0f} bytes, shares {shares})")
            if once < more:
                return aliased(part, self._joined_once(part, sub, stats, shares))
        else:
            self.decisions.append(f"multi-round: {', '.join(r for c in children for r in c.relations())}")
        first = min(children, key=lambda c: (c.relation is not None, 0))
        joined, done = self._tree(query, graph, stats, first), first.relations()
        rest = [c for c in children if c is not first]
        while rest:
            near = next((c for c in rest if any({m[0] for m in k} & set(done) and {m[0] for m in k} & set(c.relations()) for k in graph.classes)), rest[0])
            joined = self._two(query, graph, joined, done, self._tree(query, graph, stats, near), near.relations())
            done = done + near.relations()
            rest.remove(near)
        return joined


def _largest(query: MultiJoin) -> str:
    """The relation that Spark estimates largest. A chain from there reaches the relations around it by their keys before
    two of them could meet over a variable of few values."""
    return max(query.relations, key=lambda r: estimated_bytes(query.prepared(r)))


def _small_pair(query: MultiJoin, graph: QueryGraph, order: Sequence[str]) -> int:
    """Into how many parts to deal a chain's first relation where it and the second are plain tables too large for Spark to
    broadcast on its own and yet less than SMALL bytes for each core, by Spark's estimate; 0 elsewhere."""
    first, second = order[:2]
    if not query.conditions([first], second, graph) or any(derived(query.relations[r]) for r in (first, second)):
        return 0
    sizes = [estimated_bytes(query.prepared(r)) for r in (first, second)]
    cores = query.relations[first].sparkSession.sparkContext.defaultParallelism
    return 4 * cores if min(sizes) > max(_broadcast_bytes(query), 0) and sum(sizes) < SMALL * cores else 0


def _broadcast_bytes(query: MultiJoin) -> int:
    """Up to how many bytes Spark broadcasts a side of a join on its own."""
    session = next(iter(query.relations.values())).sparkSession._jsparkSession
    return session.sessionState().conf().autoBroadcastJoinThreshold()


def query_round(planner: Planner, query: MultiJoin, graph: QueryGraph, stats) -> DataFrame:
    """The whole query in one round; parts without a common variable are joined by themselves and crossed."""
    parts = graph.parts()
    if len(parts) == 1:
        shares = planner._shares(query, graph, stats, planner.local)
        planner.decisions.append(f"one-round: {', '.join(graph.relations)} (shares {shares}, {math.prod(shares)} cells)")
        return planner._joined_once(query, graph, stats, shares)
    joined = None
    for names in parts:
        part = sub_query(query, names)
        if len(names) == 1:
            piece = query.prepared(names[0])
        else:
            sub = part.graph()
            shares = planner._shares(part, sub, stats, planner.local)
            planner.decisions.append(f"one-round: {', '.join(names)} (shares {shares})")
            piece = aliased(part, planner._joined_once(part, sub, stats, shares))
        joined = piece if joined is None else joined.crossJoin(piece)
    return query.finish(joined)


def sub_query(query: MultiJoin, names: Sequence[str]) -> MultiJoin:
    """The join of some relations, without residual and output list; columns that the whole query reads stay."""
    out = MultiJoin(hidden=query.hidden, relations={r: query.relations[r] for r in names}, equalities=[e for e in query.equalities if e[0][0] in names and e[1][0] in names], local={r: query.local[r] for r in names if r in query.local})
    for members in query.graph().classes:  # relations that only a third one outside makes equal
        own = [m for m in members if m[0] in names]
        out.equalities.extend((own[0], m) for m in own[1:] if (own[0], m) not in out.equalities and m[0] != own[0][0])
    out.output = [(f"`{r}`.`{c}`", f"{r}\x1f{c}") for r in names for c in query.relations[r].columns if query.reads(r, c)]
    return out


def aliased(part: MultiJoin, joined: DataFrame) -> DataFrame:
    """The flat result of a sub-query as one struct per relation, so that relation.column still names its columns."""
    columns: dict[str, list] = {}
    for _, name in part.output:
        r, c = name.split("\x1f")
        columns.setdefault(r, []).append(F.col(f"`{name}`").alias(c))
    return joined.select(*(F.struct(*cs).alias(r) for r, cs in columns.items()))
