"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable


def _star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Hang each (u, v) of u's neighbours on low, the smallest of u and its neighbours.

    hubs: a u may have many edges. Then low is materialised, so that both sides of the join are plain shuffles and adaptive
    execution can split a hub's edges.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(durable(low) if hubs else low, "u")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component_id (its component's smallest id) for each end of the links (a, b).

    Self-links name a component of one; null ends are ignored. Raises if `rounds` don't suffice (a
    path of n nodes takes about log2 n).
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, hubs=True).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _star(large, hubs=False)  # from the larger end: few edges each
        edges = durable(small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return nodes.join(edges.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component_id"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
