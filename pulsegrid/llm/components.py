"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import settle


def _low(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node ``u``; partial minima keep a node of any degree cheap.

    Written before it is joined: a join that shares its shuffle with an aggregate is not split where a hub has
    many edges.
    """
    return settle(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = _low(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node it is connected to.

    Self-links and repeated links change nothing, links with a null end are left out, and no links
    give an empty result. Each round is written to the shared folder; the rounds grow with the
    logarithm of the longest path.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        edges = settle(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
