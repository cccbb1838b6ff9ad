"""Connected components of links between ids, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.sources.shared import settle


def _least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with ``m``, the least of u and all its neighbours in ``edges``.

    The minimum is an aggregate, reduced before the shuffle; a hub with very many links is met
    again in a join whose large partitions Spark may split.
    """
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(low.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).drop("of")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``links`` (a, b).

    Large-star and small-star steps until nothing changes: a number of rounds that grows with
    the logarithm of the number of links.  Each round is stored, so a lost executor costs no
    more than the round.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            near.select("u", F.col("m").alias("v"))
        )
        after = settle(small.filter("u <> v").distinct())
        same = edges.count() == after.count() and edges.exceptAll(after).isEmpty()
        edges = after
        if same:
            break
    named = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
