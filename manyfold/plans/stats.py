"""Statistics of relations, by one aggregation each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative standard deviation of distinct counts.
RSD = 0.05


@dataclass
class RelationStats:
    rows: int
    size_bytes: int
    distinct: Mapping[str, int]
    nulls: Mapping[str, int]
    fraction: float = 1.0
    sample: DataFrame | None = field(default=None, repr=False, compare=False)


def _width(name: str, kind: T.DataType):
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(name)))), F.lit(0))
    return F.lit(fixed.get(type(kind), 8))


def _countable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.ArrayType, T.StructType))


def collect_stats(df: DataFrame, fraction: float = 0.01, seed: int = 7) -> RelationStats:
    """Rows, bytes of the values, nulls and approximate distinct values per column, and a Bernoulli sample (lazy)."""
    quoted = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    kinds = [f.dataType for f in df.schema.fields]
    aggs = [F.count(F.lit(1)).alias("rows")]
    widths = [_width(f"c{k}", kind) for k, kind in enumerate(kinds)]
    aggs.append(F.coalesce(F.sum(sum(widths, F.lit(0)).cast("long")), F.lit(0)).alias("bytes"))
    for k, kind in enumerate(kinds):
        aggs.append(F.count_if(F.col(f"c{k}").isNull()).alias(f"n{k}"))
        if _countable(kind):
            aggs.append(F.approx_count_distinct(f"c{k}", RSD).alias(f"d{k}"))
    r = quoted.agg(*aggs).first()
    distinct = {c: r[f"d{k}"] for k, c in enumerate(df.columns) if _countable(kinds[k])}
    return RelationStats(r["rows"], r["bytes"], distinct, {c: r[f"n{k}"] for k, c in enumerate(df.columns)}, fraction, df.sample(False, fraction, seed))


_PLAIN = frozenset("Project Filter LogicalRelation LogicalRDD LocalRelation Range SubqueryAlias View InMemoryRelation HiveTableRelation DataSourceV2Relation DataSourceV2ScanRelation RelationV2".split())


def derived(df: DataFrame) -> bool:
    """Whether reading df takes more than a scan: a join, an aggregate, a sort and the like."""

    def plain(node) -> bool:
        return node.getClass().getSimpleName() in _PLAIN and all(plain(node.children().apply(k)) for k in range(node.children().size()))

    return not plain(df._jdf.queryExecution().analyzed())


def row_bytes(df: DataFrame) -> int:
    """A row's bytes as a plan estimates them before reading any."""
    return 8 + sum(20 if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else 8 for f in df.schema.fields)
