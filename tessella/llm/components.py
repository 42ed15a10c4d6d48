"""Connected components of a distributed edge list by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import write_table


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """One large-star and one small-star step on edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = write_table(large, name)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return write_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """edges (u, v) of longs to (id, component): component is the smallest id reachable. Isolated ids have no row."""
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = write_table(edges, name)
    # Done when each id points to one other and no id that is pointed to points on.
    while True:
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not chained and not edges.groupBy("u").count().where("count > 1").limit(1).count():
            break
        edges = _stars(edges, name)
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
