"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id that has a link.

    Each round ties every node and its neighbours to the smallest among them, until only stars around the smallest
    are left; a node with very many neighbours is a partial minimum and a join on its id, which splits.
    A written table cuts the lineage after each round; the one before is deleted. A link with a null end is none.
    """
    edges, before, last = _ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), None, None
    while True:
        edges = stored(edges, "links")
        if last is not None:
            release(last)
        last = edges
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        near = both.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _ordered(near.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))))
