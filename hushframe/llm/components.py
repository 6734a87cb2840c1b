"""Connected components by alternating large and small stars. Each round is a written table; nothing is gathered on the driver but a digest.

A hub's edges share a key. Its least neighbour is found by partial minima, and both sides of the join that tells it to all neighbours are plain tables, so that
the engine can split the hub's partition. Pairs of a node with itself and repeated pairs change nothing; a null end is dropped; no pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("least")), "least")


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct(), "large-stars")
    discard(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to its least one."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "stars")
    discard(least, edges)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of pairs (u, v) but the least of each component, which is its name."""
    edges = written(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == digest or not found[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        digest, before = found, edges
        edges = _small(_large(edges))
        discard(before)
