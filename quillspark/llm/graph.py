"""Connected components by contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): for each end of an edge (a, b) the smallest id that edges lead to from it.

    Each round maps every vertex to the smallest of itself and its neighbours and renames the edges; the edges that are left
    join what was mapped apart. Rounds grow with the logarithm of the longest chain. Loops, repeated and reversed edges do no
    harm; a null end is no end.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("m")), "least")
        if labels is None:
            named = least.select(F.col("v").alias("id"), F.col("m").alias("component_id"))
        else:
            named = labels.join(least, labels["component_id"] == least["v"], "left").select("id", F.coalesce("m", "component_id").alias("component_id"))
        named = cut(named, "labels")
        x, y = least.select(F.col("v").alias("a"), F.col("m").alias("ma")), least.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        left = e.join(x, "a").join(y, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        left = cut(left, "edges")
        drop(e, labels, least)
        e, labels = left, named
        if e.isEmpty():
            drop(e)
            return labels
