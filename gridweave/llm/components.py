"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among every ``u`` and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every neighbour larger than ``u`` at the smallest node around ``u``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.where("v > u").join(_least_neighbour(both), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Point every ``u`` and its smaller neighbours at the smallest of them (edges go downwards)."""
    least = _least_neighbour(edges)
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node reachable from it.

    Nodes are long ids; edges with a null end or equal ends link nothing, repeated edges count
    once, an empty table gives an empty one.  Every round is two grouped minima and two equi
    joins; its edges are written to the shared folder, so lineage stays short and a lost executor
    costs at most one round.  The rounds end when the edge set no longer changes; only its count
    and a checksum reach the driver.
    """
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(e, "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        e = materialize(_small_star(_large_star(e)), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

