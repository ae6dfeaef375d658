"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (a, b), component being the smallest id that can be reached.

    Each step is a pre-aggregated minimum and a join on the node, so a hub is split like any skewed key; a round is
    written before the next, and the number of rounds grows with the logarithm of the longest path."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        last, now = now, written(small, "edges")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return roots.unionByName(now.select(F.col("u").alias("id"), F.col("v").alias("component")))
