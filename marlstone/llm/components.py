"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_written, materialize, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's larger (large) or not larger (small) neighbours on its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # Here a > b in edges: the small star of a sees only its smaller neighbours.
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if large:
        return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return (
        hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where(F.col("a") > F.col("b"))
        .distinct()
    )


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for every node with an edge.

    ``edges`` has two orderable columns a and b; their order, repeats and loops don't matter.
    Only counts come to the driver. A star's centre keeps one row per neighbour, its joins are
    plain equi-joins that adaptive execution splits, and its minimum is aggregated before the
    shuffle.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, True), False), "edges")
        delete_written(edges.sparkSession, since=len(written) - 2, keep=1)  # the round before
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
