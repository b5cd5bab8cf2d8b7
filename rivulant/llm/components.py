"""Connected components of an undirected edge table, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.plans.scratch import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (two columns of equal type); root is the least node reachable.

    Large-star: every greater neighbour of a node moves to the node's least neighbour;
    small-star: every lesser one does.  A round costs shuffles of the edges only, the
    number of rounds grows with the logarithm of the longest path, and each round's
    edges are written to the shared checkpoint folder.
    """
    a, b = edges.columns
    here = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    here = settle(here.distinct())
    state = _state(here)
    while True:
        both = here.union(here.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(after)
        if now == state:
            roots = after.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        here, state = after, now
