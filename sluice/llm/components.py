"""Connected components over a table of links, on the executors alone.

Alternates large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Each step is a partially aggregated
minimum and a join; every round is written to the shared folder, and the loop
ends when a round changes nothing. Neither nodes nor links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return stored(edges.groupBy(F.col(node).alias("n")).agg(F.least(F.min(other), F.first(node)).alias("m")), "star-min")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both, "a", "b")
    return both.where("b > a").join(low, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _least(down, "a", "b")
    return down.join(low, F.col("a") == F.col("n")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node on a link; component is the smallest node reachable.

    Links are undirected; self-links, repeats and any order do no harm; null
    ends are ignored. No links give no rows.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        now = stored(_small_star(_large_star(now)), "links")
        r = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (r[0], r[1]) == mark:
            break
        mark = (r[0], r[1])
    root = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return root.unionAll(root.select(F.col("component").alias("node"), "component").distinct())
