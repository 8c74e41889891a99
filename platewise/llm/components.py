"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of an edge table (a, b); the label is the least vertex reachable.

    Each round hangs every vertex under the least of its neighbours, first towards larger and then
    towards smaller ones, by a minimum for each vertex and a join back; no vertex's neighbours are
    ever gathered. Rounds end when the edges no longer change: they are stars then. Self links
    keep their vertex; nulls link nothing; an empty table has no components.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("v")).distinct()
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y")).filter("x <> y")
        now = cut_lineage(small.unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y"))).distinct().select(F.col("x").alias("a"), F.col("y").alias("b")))
    stars = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "v")
    roots = now.select(F.col("b").alias("v")).unionByName(loops).distinct().join(stars, "v", "left_anti")
    return stars.unionByName(roots.withColumn("label", F.col("v")))
