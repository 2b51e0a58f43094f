"""Connected components of a table of links, by alternating large-star and small-star steps.

No component is ever gathered: each step is an aggregation by node, combined before the shuffle, and a join, whose
hot keys adaptive execution can split.  Every step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b", steps: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``: the least node that links reach, itself included."""
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pair = written(pair, "links")
    state = _state(pair)
    for _ in range(steps):
        both = pair.union(pair.select(F.col("v"), F.col("u")))
        both = both.join(_least(both), "u")
        # Large star: the larger neighbours of a node go to its least neighbour (or itself).
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u > v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        joined = large.join(_least(large), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        pair = written(small.where("u > v").distinct(), "links")
        now = _state(pair)
        if now == state:
            nodes = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.union(roots)
        state = now
    raise RuntimeError(f"components did not settle in {steps} steps")
