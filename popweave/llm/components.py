"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import stash

ROUNDS = 60


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first())


def _oriented(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).where("_u <> _v").distinct()


def _round(edges: DataFrame) -> DataFrame:
    # Large star: larger neighbours go to the smallest vertex around.
    both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
    large = large.where("_u <> _v").distinct()
    # Small star: smaller neighbours and the vertex itself go to the smallest of them.
    low = large.groupBy("_u").agg(F.min("_v").alias("_m"))
    small = large.join(low, "_u").select(
        F.when(F.col("_v") == F.col("_m"), F.col("_u")).otherwise(F.col("_v")).alias("_u"), F.col("_m").alias("_v"))
    return stash(small.unionByName(low.select("_u", F.col("_m").alias("_v"))).distinct(), "links")


def partial_components(links: DataFrame, a: str, b: str, rounds: int = 2) -> DataFrame:
    """``_u, _v``: vertices with a connected smaller one after a fixed number of rounds.

    Vertices with the same ``_v`` are connected; connected ones may differ yet.
    """
    edges = _oriented(links, a, b)
    for _ in range(rounds):
        edges = _round(edges)
    return edges.groupBy("_u").agg(F.min("_v").alias("_v"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``_u, _v``: each vertex that has a link to another, with the smallest vertex of its component.

    Each round is one aggregation and one join over the links; links shrink to
    stars in a logarithmic number of rounds.  Nothing but two numbers a round
    reaches the driver.
    """
    edges = stash(_oriented(links, a, b), "links")
    before = _measure(edges)
    for _ in range(ROUNDS if before[0] else 0):
        edges = _round(edges)
        after = _measure(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components not found in {ROUNDS} rounds")
    # At the fixed point every vertex points at its component's smallest; that one points at itself.
    return edges.unionByName(edges.select(F.col("_v").alias("_u"), "_v")).distinct()
