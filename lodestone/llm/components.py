"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): every node of ``links`` with the least node it is linked to.

    Alternates large-star and small-star steps: each ties a node's neighbours to the least
    of them, until every node hangs on its component's least node directly. Each round is
    kept in the shared folder, so lineage stays short. Null ends and self-links are ignored;
    a table without links gives no rows.
    """
    ends = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    edges = checkpoint(links.where(F.col(a) != F.col(b)).select(*ends).distinct())
    while not _settled(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    tops = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end and no lower end is an upper end."""
    ups = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not ups.where("n > 1").isEmpty():
        return False
    return edges.select("v").distinct().join(ups, F.col("v") == F.col("u"), "left_semi").isEmpty()
