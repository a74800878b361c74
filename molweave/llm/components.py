"""Connected components of a graph by randomised contraction, without collecting links or groups.

Each round gives every vertex the neighbour (or itself) with the smallest hash under a fresh seed and merges the
two; the expected number of remaining vertices falls by a constant factor, so rounds grow with the logarithm of
the largest component, long chains included. A round is one aggregation (combined before the shuffle, so a hub is
no hot task) and joins on vertex ids, which adaptive execution can split. Every round is written to the shared
folder, so a lost executor costs one read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of ``edges`` with the smallest vertex id of its component.

    Vertices without a link do not occur in the result. Nulls, self links and repeated links are ignored; an
    empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    live = materialise(pairs, "links")
    maps = []
    seed = 0
    while not live.isEmpty():
        # both directions; choose the neighbour (or self) of smallest hash
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("to"))  # noqa: E731, B023
        chosen = both.groupBy("a").agg(F.least(F.min(rank(F.col("b"))), rank(F.col("a"))).alias("m"))
        chosen = materialise(chosen.select(F.col("a").alias("id"), F.col("m.to").alias("to")), "chosen")
        maps.append(chosen)
        left = chosen.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = chosen.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = live.join(left, "a").join(right, "b").where(F.col("x") != F.col("y"))
        live = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        seed += 1
    if not maps:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # a vertex of round r goes to chosen[r]; what it goes to may go on in round r+1
    def step(now: DataFrame, later: DataFrame) -> DataFrame:
        onward = later.select(F.col("id").alias("to"), F.col("to").alias("onward"))
        return now.join(onward, "to", "left").select("id", F.coalesce("onward", "to").alias("to"))

    ends = materialise(reduce(step, maps), "ends")
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    return materialise(ends.join(least, "to").select("id", "component"), "components")
