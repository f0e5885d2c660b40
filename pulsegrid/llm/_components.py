"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import dropped, staged


def _state(edges: DataFrame) -> tuple:
    """Enough to see whether a step has changed anything: one row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.countDistinct("hi")).first())


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b), root the smallest node reachable.

    Roots come out as nodes of their own. Each step writes its links to the
    shared folder; the number of steps follows the logarithm of the longest
    path. Nothing of the graph goes to the driver.
    """
    now = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    state = _state(now)
    for _ in range(limit):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        low = now.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        low = low.unionByName(now.select(F.col("lo").alias("k"), F.col("lo").alias("m")).distinct()).groupBy("k").agg(F.min("m").alias("m"))
        large = both.join(low, F.col("hi") == F.col("k")).where("lo > k").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large, "large-star")
        low = large.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        small = large.join(low, F.col("hi") == F.col("k")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.unionByName(low.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        small = staged(small, "small-star")
        dropped(large)
        dropped(now)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {limit} steps")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
