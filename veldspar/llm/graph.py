"""Connected components of a table of links, by alternating large and small stars over shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each u sends its neighbours (the larger, or the smaller and itself) to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    sent = both.join(least, both.u == least.w).where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        sent = sent.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return sent.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """links (a, b) of integers -> (id, component_id) for every linked id; component_id is the least id reachable."""
    edges = common.stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = common.stored(_star(_star(edges, True), False), "stars")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        common.drop_stored(edges)
        edges = now
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
