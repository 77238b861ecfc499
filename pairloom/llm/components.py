"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins over the edges alone, never over the documents; rounds grow
with the logarithm of the longest chain. Each step is written to the shared folder, so an executor that is
lost costs one step at most. Hubs are reduced by min(), partly before the shuffle; where their edges then meet
that minimum both sides are plain scans, so that the skew-join rule can split a hub over many tasks. They are merged, never
broadcast, so that the driver holds no part of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.frames import kept


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return kept(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(e: DataFrame) -> DataFrame:
    least = kept(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = e.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple[int, int | None]:
    got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) that is not itself the least of its component.

    Loops, repeated edges and either direction are fine; no edges give no rows.
    """
    e = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        e = kept(_small_star(_large_star(e)), "stars")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
