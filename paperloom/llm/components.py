"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, drop_tables
from .skew import split_lookup


def _star(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and all v of that u."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    least = least.withColumn("m", F.least("u", "m"))
    return split_lookup(pairs, least, "u", "n")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Each round joins every node with the least of its neighbourhood (first
    among larger, then among smaller neighbours), which ends in stars after
    about log(longest path) rounds. State is cut after each round; a node with
    very many neighbours is met by :func:`split_lookup`. Loops and repeated
    edges are allowed, nulls are left out; no edges give no rows.
    """
    ends = lambda df: df.filter("u > v").distinct()
    now = cut(ends(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    told = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(ends(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        star = _star(large)
        small = star.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        after = cut(ends(small), "small")
        drop_tables(after.sparkSession, now, large)
        now = after
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if said == told:
            break
        told = said
    else:
        raise RuntimeError(f"no stars after {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
