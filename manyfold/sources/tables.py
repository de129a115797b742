"""Named tables with statistics, read from files or given as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.plans.stats import RelationStats, collect_stats


class Tables:
    """name -> DataFrame; statistics of a column are taken once per registration, when first asked for or at once."""

    def __init__(self, spark: SparkSession, sample_fraction: float = 0.01):
        self.spark, self.sample_fraction = spark, sample_fraction
        self._frames: dict[str, DataFrame] = {}
        self._stats: dict[str, dict[frozenset[str], RelationStats]] = {}

    def register(self, name: str, df: DataFrame, analyse: bool = False) -> DataFrame:
        """Also a temporary view of that name; a second registration replaces the first, statistics too."""
        df.createOrReplaceTempView(name)
        self._frames[name.lower()] = df
        self._stats.pop(name.lower(), None)
        if analyse:
            self.stats(name)
        return df

    def read(self, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
        return self.register(name, self.spark.read.format(fmt).options(**options).load(path))

    def write(self, df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
        df.write.format(fmt).mode(mode).options(**options).save(path)

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._frames

    def frame(self, name: str) -> DataFrame:
        return self._frames[name.lower()] if name in self else self.spark.table(name)

    def stats(self, name: str, columns: Iterable[str] | None = None) -> RelationStats:
        """Statistics that cover the columns (all of them where none are named); only columns that are asked for are read."""
        df, known = self.frame(name), self._stats.setdefault(name.lower(), {})
        wanted = frozenset(df.columns if columns is None else columns)
        for have, found in known.items():
            if wanted <= have:
                return found
        read = [c for c in df.columns if c in wanted]
        known[wanted] = collect_stats(df.select(*(F.col(f"`{c}`") for c in read)) if read else df.select(F.lit(1).alias("one")), self.sample_fraction)
        return known[wanted]
