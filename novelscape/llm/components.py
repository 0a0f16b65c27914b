"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common


def _edges(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``u, v``) that is not the smallest node of its component.

    A round hangs the larger neighbors of each node on its smallest neighbor, then each node's smaller neighbors on the
    smallest of them; the number of rounds grows with the logarithm of a component's size. Smallest neighbors are
    aggregated before the shuffle and joined as one row for each node, so a node with very many links is no group of
    its own in any task.
    """
    spark = links.sparkSession
    path = common.scratch(spark)
    edges = common.stored(_edges(links), path)
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _edges(large).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(smallest.select("u", F.col("m").alias("v")))
        new = common.scratch(spark)
        edges = common.stored(_edges(small), new)
        common.drop(spark, path)
        path, now = new, _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
