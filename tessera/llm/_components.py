"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import small, stash


def _least(pairs: DataFrame) -> DataFrame:
    """For each u its neighbours, and the least of them and itself: (u, v, m). The least ones are stored, so that their join with the stored pairs is a stage of its own, in which a star's many rows are broadcast to or split."""
    least = stash(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(small(least), "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of links (a, b), the least node that it is connected with. Each half round is stored, so lineage stays short."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stash(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        near = _least(large)  # here every v is below its u
        edges = stash(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
