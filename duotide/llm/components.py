"""Connected components of an edge list, by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest neighbour; the number of edges never grows and the rounds needed grow
with the logarithm of the longest path. Rounds are written below
``spark.checkpoint.dir``, so a lost executor costs one round at most. The
driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotide import scratch

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node that is not its component's smallest.

    Loops, repeated edges and null ends are left out. No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = scratch.materialise(e, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
