"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import remove, save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m"))
    return (both.join(least, "src").where("dst > src")
            .select(F.col("dst").alias("src"), F.least("src", "m").alias("dst")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = (edges.join(least, "src").where("dst <> m")
             .select(F.col("dst").alias("src"), F.col("m").alias("dst")))
    return moved.unionByName(least.select("src", F.col("m").alias("dst")))


def _is_star_forest(edges: DataFrame) -> bool:
    ends = (edges.select(F.col("src").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            .unionByName(edges.select(F.col("dst").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    bad = ends.groupBy("n").agg(F.sum("out").alias("o"), F.sum("into").alias("i")).where("o > 1 or (o >= 1 and i >= 1)")
    return bad.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of any comparable type -> ``(node, component)``.

    The component is its smallest node.  Only nodes with an edge to another
    node are listed; self-loops, repeated edges and nulls are ignored, and no
    edges give no rows.  Each round rewrites every edge towards the least
    known neighbour (large star, then small star), never adds edges, and is
    written to the shared folder; the number of rounds grows with the
    logarithm of the number of nodes.  Hot nodes only meet partial
    aggregations and joins that adaptive execution can split."""
    spark = edges.sparkSession
    edges = (edges.where("src is not null and dst is not null and src <> dst")
             .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    now, path = save(edges, "cc")
    while not _is_star_forest(now):
        stars, mid = save(_large_star(now).distinct(), "cc")
        remove(spark, path)
        now, path = save(_small_star(stars).distinct(), "cc")
        remove(spark, mid)
    leaves = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    centres = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return leaves.unionByName(centres)
