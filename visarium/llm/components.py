"""Connected components of links between keys, by alternating large and small stars.

Every round is a few joins and groupings on keys; a key with very many links meets them in a join that the planner can
split, and in a grouping that sums up before it shuffles. The links are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """key, root for every key of links (a, b): root is the smallest key that links lead to. Self links are allowed."""
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links")
    while True:
        # Large star: all larger neighbours of a key are tied to its smallest neighbour (or itself).
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # Small star: a key and its smaller neighbours are tied to the smallest of them.
        large = stored(large.filter("hi <> lo").distinct(), "large")
        small_m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_m, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(small_m.select("hi", F.col("m").alias("lo")))
        after = stored(small.filter("hi <> lo").distinct(), "links")
        same = after.count() == edges.count() and after.join(edges, ["hi", "lo"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return edges.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("key"), "root")
