"""Bloom filters of relations that close cycles, tested on a chain's rows before these are sent or sorted to meet them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column, _to_seq

from manyfold.operators.binary import estimated_bytes
from manyfold.plans.cost import IndependenceEstimator
from manyfold.plans.graph import QueryGraph
from manyfold.plans.query import MultiJoin, collated, key_type, normal, ref
from manyfold.plans.stats import RelationStats

#: Bits for each key. Spark holds a filter to 8 MB (spark.sql.optimizer.runtime.bloomFilter.maxNumBits).
BITS = 10


def sieved(df: DataFrame, keys: Sequence[SparkColumn], relation: DataFrame, relation_keys: Sequence[SparkColumn], rows: int) -> DataFrame:
    """The rows of df whose keys may be among the relation's, and all that are: keys in forms in which equal ones are equal
    bytes. Spark makes the filter once, by one aggregation of the relation."""
    spark = df.sparkSession
    jvm, seq = spark._jvm, lambda items: _to_seq(spark.sparkContext, items, _to_java_column)
    sizes = [F.lit(n).cast("long") for n in (max(rows, 1), max(rows, 1000) * BITS)]
    made = jvm.PythonSQLUtils.internalFn("bloom_filter_agg", seq([F.xxhash64(*relation_keys), *sizes]))
    plan = relation.agg(ClassicColumn(made).alias("__sieve"))._jdf.queryExecution().analyzed()
    expressions, none, no = jvm.org.apache.spark.sql.catalyst.expressions, jvm.scala.Option.empty(), jvm.PythonUtils.toSeq([])
    bits = expressions.ScalarSubquery(plan, no, expressions.NamedExpression.newExprId(), no, none, none, none)
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = expressions.BloomFilterMightContain(bits, columns.expression(_to_java_column(F.xxhash64(*keys))))
    return df.filter(ClassicColumn(columns.column(test)))


class Sieves:
    """Called with a chain's rows after each join: relations still to come that meet two or more variables there, and leave
    at most a quarter of the rows by estimate, are tested by a filter at once. Each once; the joins themselves stay.

    most: rows that a relation may have, so that its filter stays sharp. least: rows, by estimate, from which on a test is
    worth it. plain: the joins are Spark's over whole relations, so that those which it broadcasts need no filter."""

    def __init__(self, query: MultiJoin, graph: QueryGraph, stats: Mapping[str, RelationStats], most: int, least: int, plain: bool):
        self.query, self.graph, self.stats, self.most, self.least = query, graph, stats, most, least
        session = next(iter(query.relations.values())).sparkSession._jsparkSession
        limit = session.sessionState().conf().autoBroadcastJoinThreshold()
        kinds = [key_type(query.type_of(m) for m in members) for members in graph.classes]
        self.kinds = {v: kind for v, kind in enumerate(kinds) if kind is not None and not collated(kind)}
        self.able = [r for r in graph.relations if stats[r].rows <= most and not (plain and estimated_bytes(query.prepared(r)) <= limit)]
        self.used: set[str] = set()

    def closing(self, done: Sequence[str]) -> list[str]:
        """Relations not among those joined whose filters are worth a test on the joined rows."""
        out, estimate = [], lambda names: IndependenceEstimator().join_rows(self.query, self.graph, self.stats, names)
        rows = estimate(done) if len(done) > 1 else 0
        for r in self.able:
            if r not in done and rows >= self.least and len(self._shared(done, r)) > 1 and estimate([*done, r]) * 4 <= rows:
                out.append(r)
        return out

    def _shared(self, done: Sequence[str], r: str) -> list[int]:
        held = frozenset().union(*(self.graph.of[s] for s in done))
        return [v for v in sorted(self.graph.of[r] & held) if v in self.kinds]

    def __call__(self, joined: DataFrame, done: Sequence[str]) -> DataFrame:
        for r in self.closing(done):
            if r in self.used:
                continue
            self.used.add(r)
            keys = {v: {m[0]: m for m in reversed(self.graph.classes[v])} for v in self._shared(done, r)}
            mine = [normal(ref(next(members[s] for s in done if s in members)), self.kinds[v]) for v, members in keys.items()]
            own = [normal(ref(members[r]), self.kinds[v]) for v, members in keys.items()]
            joined = sieved(joined, mine, self.query.prepared(r), own, self.stats[r].rows)
        return joined
