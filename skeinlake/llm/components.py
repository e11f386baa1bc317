"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import jobs


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(edges: DataFrame, tmp: jobs.Scratch, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, keeper) for every node of the edges (a, b); the keeper is the smallest node of its component.

    Self loops and repeated edges are allowed. ``known`` are components of a part of the edges. Ends when a round
    leaves the edges as they are: then each component is one star around its smallest node.
    """
    if known is not None:
        edges = edges.unionByName(known.select(F.col("keeper").alias("a"), F.col("doc_id").alias("b")))
    edges = tmp.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == mark:
            break
        mark = now
        edges = tmp.save(_small_star(_large_star(edges)))
    centers = edges.select("a").distinct().select(F.col("a").alias("doc_id"), F.col("a").alias("keeper"))
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("keeper")).unionByName(centers)
