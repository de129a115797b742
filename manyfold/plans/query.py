"""A multi-way inner join: relations, classified predicates and an output list."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyfold.plans.graph import Column, QueryGraph

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def ref(column: Column) -> SparkColumn:
    """The column of an aliased relation."""
    return F.col(f"`{column[0]}`.`{column[1]}`")


def key_type(kinds: Iterable[T.DataType]) -> T.DataType | None:
    """The type in which keys of these types can be hashed alike; None if SQL's = needs another comparison."""
    kinds = list(kinds)
    if all(isinstance(k, _WHOLE) for k in kinds):
        return T.LongType()
    if all(isinstance(k, _REAL) for k in kinds):
        return T.DoubleType()
    plain = (T.StringType, T.DateType, T.TimestampType, T.BooleanType, T.BinaryType, T.DecimalType)
    return kinds[0] if all(k == kinds[0] for k in kinds) and isinstance(kinds[0], plain) else None


def collated(kind: T.DataType | None) -> bool:
    """Whether equal strings of the type may differ in their bytes."""
    return isinstance(kind, T.StringType) and getattr(kind, "collation", "UTF8_BINARY") != "UTF8_BINARY"


def normal(column: SparkColumn, kind: T.DataType) -> SparkColumn:
    """The key in its common type; of numbers that SQL takes as equal (0.0 and -0.0, all NaN) one form."""
    column = column.cast(kind)
    if isinstance(kind, T.DoubleType):
        return F.when(F.isnan(column), F.lit(float("nan"))).otherwise(column + F.lit(0.0))
    return column


def _stand_in(kind: T.DataType) -> SparkColumn:
    """A value of the type to put in a null's place, beside a flag that it was one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)


# --- Catalyst's parse trees, walked from Python --------------------------------------------------------------------


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _seq(s) -> list:
    return [s.apply(k) for k in range(s.size())]


def _names(expression) -> set[tuple[str, ...]]:
    if _kind(expression) == "UnresolvedAttribute":
        return {tuple(_seq(expression.nameParts()))}
    return {n for child in _seq(expression.children()) for n in _names(child)}


def _conjuncts(expression) -> list:
    if _kind(expression) == "And":
        return _conjuncts(expression.left()) + _conjuncts(expression.right())
    return [expression]


def parse_expression(spark: SparkSession, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(text)


class NotPlain(ValueError):
    """An expression whose SQL text would not parse back to itself."""


def plain_text(spark: SparkSession, expression, given: str | None = None) -> str:
    """The expression's SQL text, or the given text, if it means the same."""
    for text in (expression.sql(), given):
        try:
            if text is not None and parse_expression(spark, text).equals(expression):
                return text
        except Exception as e:  # the parser's own exceptions come through the gateway
            if "Parse" not in str(e):
                raise
    raise NotPlain(f"can't be written as plain SQL by itself: {expression.sql()}")


@dataclass
class MultiJoin:
    """relations: name -> DataFrame, in query order. equalities: pairs of columns of different relations.

    local: predicates over one relation. residual: all others, equalities between keys of unlike types among them. No
    conjunct is ever dropped. output: (SQL expression, name) pairs; empty for all columns as relation_column. hidden: key
    columns that the query itself adds to relations, for equalities between expressions and null-safe ones.
    """

    relations: dict[str, DataFrame]
    equalities: list[tuple[Column, Column]] = field(default_factory=list)
    local: dict[str, list[str]] = field(default_factory=dict)
    residual: list[str] = field(default_factory=list)
    output: list[tuple[str, str]] = field(default_factory=list)
    hidden: set[str] = field(default_factory=set)

    @classmethod
    def build(cls, relations: Mapping[str, DataFrame], predicates: Sequence[str] = (), output: Sequence[tuple[str, str]] = ()) -> MultiJoin:
        """predicates: SQL text over relation.column (or a column name that only one relation has), joined by AND."""
        query = cls(dict(relations), output=list(output))
        if not query.relations:
            raise ValueError("a join needs relations")
        spark = next(iter(query.relations.values())).sparkSession
        for text in predicates:
            for conjunct in _conjuncts(parse_expression(spark, text)):
                query._classify(conjunct, text)
        return query

    def resolve(self, parts: Sequence[str]) -> Column:
        names = {r.lower(): r for r in self.relations}
        if len(parts) > 1 and parts[0].lower() in names:
            relation = names[parts[0].lower()]
            for c in self.relations[relation].columns:
                if c.lower() == parts[1].lower():
                    return relation, c
            raise ValueError(f"{relation} has no column {parts[1]}")
        holders = [(r, c) for r, df in self.relations.items() for c in df.columns if c.lower() == parts[0].lower()]
        if len(holders) != 1:
            raise ValueError(f"{'.'.join(parts)} is {'ambiguous' if holders else 'unknown'}")
        return holders[0]

    def type_of(self, column: Column) -> T.DataType:
        return self.relations[column[0]].schema[column[1]].dataType

    def _classify(self, conjunct, given: str | None = None) -> None:
        columns = {self.resolve(n) for n in _names(conjunct)}
        touched = {c[0] for c in columns}
        text = plain_text(next(iter(self.relations.values())).sparkSession, conjunct, given)
        if len(touched) == 1:
            self.local.setdefault(touched.pop(), []).append(text)
            return
        if len(touched) == 2 and _kind(conjunct) in ("EqualTo", "EqualNullSafe") and self._equality(conjunct):
            return
        self.residual.append(text)

    def _equality(self, conjunct) -> bool:
        """Takes an equality of two relations' keys, columns or expressions; False if it has to stay a residual."""
        spark = next(iter(self.relations.values())).sparkSession
        sides = []
        for side in (conjunct.left(), conjunct.right()):
            holders = {self.resolve(n)[0] for n in _names(side)}
            if len(holders) != 1:
                return False
            relation = holders.pop()
            if _kind(side) == "UnresolvedAttribute" and len(_seq(side.nameParts())) <= 2:
                column = self.resolve(_seq(side.nameParts()))
                sides.append((relation, column, None, self.type_of(column)))
                continue
            text = plain_text(spark, side)
            alone = self.relations[relation].alias(relation).select(F.expr(text))
            if not alone._jdf.queryExecution().analyzed().deterministic():
                return False
            sides.append((relation, None, text, alone.schema[0].dataType))
        kind = key_type(s[3] for s in sides)
        if kind is None or sides[0][0] == sides[1][0]:
            return False
        values = [F.expr(text) if column is None else ref(column) for _, column, text, _ in sides]
        if _kind(conjunct) == "EqualNullSafe":
            for made in ([F.isnull(v) for v in values], [F.coalesce(v.cast(kind), _stand_in(kind)) for v in values]):
                self.equalities.append(tuple(self._add(s[0], m) for s, m in zip(sides, made, strict=True)))
            return True
        self.equalities.append(tuple(column or self._add(relation, v) for (relation, column, _, _), v in zip(sides, values, strict=True)))
        return True

    def _add(self, relation: str, value: SparkColumn) -> Column:
        name = f"__key{len(self.hidden)}"
        self.hidden.add(name)
        self.relations[relation] = self.relations[relation].alias(relation).select("*", value.alias(name))
        return relation, name

    def graph(self) -> QueryGraph:
        return QueryGraph.build(self.relations, self.equalities)

    def prepared(self, name: str, extra: Mapping[str, SparkColumn] | None = None) -> DataFrame:
        """The relation under its alias: own predicates applied, null keys and unread columns left out."""
        graph = self.graph()
        df = self.relations[name].alias(name)
        for text in self.local.get(name, ()):
            df = df.filter(F.expr(text))
        for members in graph.classes:
            own = [m for m in members if m[0] == name]
            for m in own:
                df = df.filter(ref(m).isNotNull())
            for m in own[1:]:
                df = df.filter(ref(own[0]) == ref(m))
        keep = [ref((name, c)) for c in self.relations[name].columns if self.reads(name, c)]
        return df.select(*keep, *(c.alias(k) for k, c in (extra or {}).items())).alias(name)

    def reads(self, name: str, column: str) -> bool:
        if not self.output:
            return True
        if not hasattr(self, "_read"):
            spark = self.relations[name].sparkSession
            self._read = {c for pair in self.equalities for c in pair}
            for text in [*self.residual, *(e for e, _ in self.output)]:
                self._read |= {self.resolve(n) for n in _names(parse_expression(spark, text))}
        return (name, column) in self._read

    def finish(self, joined: DataFrame) -> DataFrame:
        """Residual predicates and the output list over the joined relations."""
        for text in self.residual:
            joined = joined.filter(F.expr(text))
        return self.project(joined)

    def project(self, joined: DataFrame) -> DataFrame:
        if self.output:
            return joined.select(*(F.expr(e).alias(name) for e, name in self.output))
        return joined.select(*(ref((r, c)).alias(f"{r}_{c}") for r, df in self.relations.items() for c in df.columns if c not in self.hidden))

    def conditions(self, done: Iterable[str], name: str, graph: QueryGraph) -> list[SparkColumn]:
        """Equalities of a relation's variables with holders among the relations joined already."""
        done = set(done)
        out = []
        for members in graph.classes:
            own = next((m for m in members if m[0] == name), None)
            other = next((m for m in members if m[0] in done), None)
            if own and other:
                out.append(ref(other) == ref(own))
        return out
