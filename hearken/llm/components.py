"""Connected components of an edge table by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import stage, workspace


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v), u != v, of any orderable type -> (u, v) with v the least node of u's component, for every u that isn't it.

    Each round joins neighbours to the least one on both sides of every node; rounds grow with the logarithm of the
    longest chain.  Every round is written to the shared folder, so no lineage grows and a lost executor costs one round.
    Only a count and a sum of hashes come to the driver.  A node with very many neighbours is met by joins, which
    Spark can split, never by a gathered list.
    """
    with workspace(edges.sparkSession) as keep:
        return keep(_stars(edges), "components")


def _stars(edges: DataFrame) -> DataFrame:
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").filter("u <> v").distinct(), "edges")
        before, seen = seen, _state(now)
        if seen == before:
            break
    return now
