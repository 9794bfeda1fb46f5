"""Connected components of a table of links, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import stage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then v is its component."""
    n, distinct = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == distinct and edges.join(edges.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").limit(1).count() == 0


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links(a, b)``.

    Alternating large-star and small-star steps over (u, v) with u > v: each
    step hangs the neighbours of a node below its smallest one, which takes a
    logarithmic number of rounds and keeps the table at most as large as it was.
    Minima are added up before they shuffle and written, so that a join with them
    can split the links of a node that holds a third of all. An empty table gives
    an empty one.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage(spark, edges, "edges")
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours hang below the least of the neighbourhood
        m = stage(spark, _least_neighbour(both).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        # small star: smaller neighbours and the node itself likewise
        m = _least_neighbour(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        edges = stage(spark, small.filter("u != v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
