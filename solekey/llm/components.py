"""Connected components of a graph that is only ever held as a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node reachable.

    Each round hangs the larger neighbours of a node below its smallest one, then the smaller
    ones, until every component is a star. Rounds are written to the checkpoint folder; only
    one count and one sum per round reach the driver. Edges with a null end and loops are
    ignored; no edges give an empty frame. A node with very many neighbours is pre-aggregated
    before it is joined, and the join is a plain sort-merge join that Spark can split.
    """
    stars = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        count, total = stars.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if not count or (count, total) == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = (count, total)
        stars = durable(_smaller(_larger(stars)))


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
