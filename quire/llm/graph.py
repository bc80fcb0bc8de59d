"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


def components(edges: DataFrame) -> DataFrame | None:
    """``node, comp`` for every node of the edges ``a, b`` (long): the smallest
    node reachable. None without an edge between different nodes.

    Each round every node points to its smallest neighbour, pointers are
    followed to their ends, and the edges are contracted to those ends; rounds
    fall with the logarithm of a component's diameter. Tables only; nothing but
    emptiness tests comes to the driver. Joins on a pointer's end, where a
    large component makes a hot key, have one row on the other side, which
    Spark's skew splitting copies.
    """
    e = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("up")))
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = cut_lineage(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            if up.where("moved").isEmpty():
                break
        up = up.select("node", "up")
        found = up.withColumnRenamed("up", "comp") if found is None else cut_lineage(
            found.join(up.withColumnRenamed("node", "comp"), "comp", "left")
            .select("node", F.coalesce("up", "comp").alias("comp")))
        e = cut_lineage(e.join(up.select(F.col("node").alias("a"), F.col("up").alias("ca")), "a")
                        .join(up.select(F.col("node").alias("b"), F.col("up").alias("cb")), "b").where("ca <> cb")
                        .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    return found
