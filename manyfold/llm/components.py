"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the least id that can be reached, for every id with an edge.

    Each step takes the least label of the neighbours and then the label of that label; the number of steps grows
    with the logarithm of a component's width. Labels and edges stay distributed; every step is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("at"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("beyond"))
        step = written(moved.join(jump, "at").select("id", "old", F.least("at", "beyond").alias("component")), "labels")
        labels = step.select("id", "component")
        if not step.filter("old != component").take(1):
            return labels
