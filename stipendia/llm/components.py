"""Connected components of a link table, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.llm.common import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (u, v) with u > v.

    Minima are aggregated before they are joined back, so a node with most of the links costs one row a task.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): the smallest id reachable.

    Alternates the two star steps until nothing changes; each round is written to the shared folder.  Repeated links
    and links of a node with itself change nothing.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        edges = saved(_stars(_stars(edges, True), False))
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
