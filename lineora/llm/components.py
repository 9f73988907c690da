"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineora.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    tied = down.join(least, F.col("u") == F.col("c"))
    return tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("c", "m")).toDF("u", "v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node. Self-loops and nulls are dropped."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    edges = cut(edges, "edges")
    seen = None
    while True:
        edges = cut(_small_star(cut(_large_star(edges), "edges")), "edges")
        if (now := _mark(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()).toDF("node", "root").distinct()
