"""Distributed connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join; edges stay as many as they were or become fewer, and
a hub's edges meet only in partial minima and in a join whose skewed side adaptive execution can split.
Each round is a written table, so lineage stays short and a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long); component is the smallest id reachable.

    Nulls, loops and repeated edges are ignored; without other edges the result is empty.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # A small-star step first: it makes all edges of a node that isn't a hub into one, and a few of hubs.
    least = now.groupBy("u").agg(F.min("v").alias("m"))
    small = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    now = work.write(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(least.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = work.write(small.unionByName(least).distinct(), "stars")
        after = _state(new)
        work.drop(now)
        now, before, state = new, state, after
        if after == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
