"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it can reach) for every node with a link; links of nulls are dropped.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes: every round is two aggregations and
    joins on the node, each round's edges are written to the shared folder, and no list of neighbours is ever gathered.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    edges = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x != y")
    path, edges = kept(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges_next = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        new_path, edges = kept(edges_next)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        drop_stored(spark, path)
        path = new_path
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
