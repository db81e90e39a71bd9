"""Connected components in DataFrame operations, by alternating large and small stars.

Each round is two joins on a node with the least of its neighbours; no neighbour list is
ever gathered, and each round's edges are written to the shared folder. The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour that is larger (or else not larger) than its node to the least one."""
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u != v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, comp`` for every node of ``edges(a, b)``; ``comp`` is the least node reachable."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(most):
        flipped = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        big = _star(now.unionByName(flipped), True)
        now = staged(_star(big, False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
