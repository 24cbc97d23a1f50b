"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours of u move to the least id seen at u. Least ids are partial aggregates, so a hub costs no more."""
    pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = pairs.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of each id in edges (u, v), both long; component is the least id that is reachable.

    Self-loops and repeated edges are allowed. Nulls are not: filter them before.
    """
    now = stored(edges.where("u <> v").select("u", "v"), "edges")
    before = None
    for _ in range(rounds):
        had, now = now, stored(_star(_star(now, True), False), "edges")
        forget(had)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
