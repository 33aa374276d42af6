"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, scratch_dir


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star round; edges (u, v) of any direction to edges towards smaller nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    # A node keeps the edge to its least neighbour and hands its other neighbours on to that one.
    kept = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return large.join(least, "u").select(kept.alias("u"), F.col("m").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, which has none itself."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("low")), F.struct(F.col("v").alias("node"), F.lit(0).alias("low"))))
    nodes = edges.select((F.col("u") < F.col("v")).alias("up"), ends.alias("end")).groupBy("end.node")
    nodes = nodes.agg(F.max("up").alias("up"), F.sum("end.low").alias("down"), F.count("*").alias("n"))
    return nodes.where("up OR down > 1 OR down BETWEEN 1 AND n - 1").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to one row (u, root) per node that is not the smallest of its component.

    Ends when all edges are stars around smallest nodes, which one aggregate over the nodes tells without
    another round; each round is written to the shared folder and the one before removed, so lineage stays
    short.  Minima are combined before each shuffle; the joins are plain inner joins, so a node's edges may
    meet in one task where Spark doesn't split it.  Null or equal ends are no links; edges may repeat.
    """
    spark, folder = edges.sparkSession, scratch_dir(edges.sparkSession, "edges")
    edges = materialise(edges.where("u <> v").select("u", "v"), "edges", folder)
    while not _are_stars(edges):
        last, folder = folder, scratch_dir(spark, "edges")
        edges = materialise(_stars(edges), "edges", folder)
        discard(spark, last)
    return edges.withColumnRenamed("v", "root")
