"""Connected components by alternating large-star and small-star steps, as joins.

Every step replaces edges by edges to smaller neighbours; node degrees are never collected, only
their least neighbour (combined before the shuffle). Each round is written, so lineage stays short
and a lost executor repeats one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.sources.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root``: the least node of the component, for every node of an edge (``u``, ``v``)
    that is not its own root. Nodes may be of any type that has an order."""
    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return e.select("u", F.col("v").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u != v").distinct(), "edges")
