"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Node and the smallest node it reaches, for every node with an edge.

    Alternates large-star and small-star steps until the edges no longer change; each step is two
    aggregations whose rows shrink towards one star per component. Nodes and edges stay distributed.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = stored(e.groupBy("a").agg(F.min("b").alias("m")))
        linked = e.join(least, "a")
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    # a star's centre is a hot key of the joins below; Spark's skew join splits it, as `least` is a stored table
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        e = stored(small(large(e)))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
