"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.plans.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (u, v) the smallest node it is connected with.

    Alternating large-star and small-star steps; each needs one aggregation and one join and hangs the neighbours
    of a node on the smallest of them, so the number of rounds grows with the logarithm of a component's size. Each round's
    edges are written to scratch, so a lost executor costs no earlier round. Loops and repeated edges are allowed.
    """
    def mark(edges: DataFrame) -> tuple:
        """What changes whenever the edges do: their number, and two sums over hashes of them."""
        return tuple(edges.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]).first())

    at = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    old = mark(at)
    while True:
        both = at.select("u", "v").unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")
        )
        new = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        at, now = new, mark(new)
        if now == old:
            break
        old = now
    leaves = at.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
