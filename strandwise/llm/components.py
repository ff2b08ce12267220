"""Connected components of a link table that no machine has to hold.

Alternating stars: every node links its larger neighbours to its least neighbour, then its
smaller ones. Each step is an aggregate (least neighbour, combined before the shuffle) and a
join by node; a component of diameter d settles in about log d rounds. Each round is stored in
the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import drop_stored, store


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").select("u", "v", F.least("u", "m").alias("m"))
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    joined = edges.join(_least(edges), "u")
    moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links`` (two long columns, any order, repeats and
    loops allowed); ``component`` is the least node reachable. Null ends are no links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = edges.toDF("u", "v", "whole").filter("whole and u <> v").select("u", "v").distinct()
    edges = store(edges, "links")
    state = None
    while True:
        after = store(_small_star(_large_star(edges)), "stars")
        drop_stored(edges)
        edges = after
        # Order-independent digest of the table: no change means every node points at its root.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
