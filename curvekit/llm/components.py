"""Connected components by contraction rounds; every round is written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage


def components(edges: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """`node`, `root` for all ends of `edges`.

    In each round every node moves to the smallest of itself and its neighbours and the edges move along; edges within one node vanish. With hashed node
    names the graph shrinks by a constant factor a round. Minima combine on the map side, so a node may have any number of edges.
    """
    own = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    own = cut_lineage(own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = None
    while True:
        moved = cut_lineage(own.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
        if roots is None:
            roots = moved.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = roots.join(moved, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = cut_lineage(roots)
        step = own.join(moved.select("u", F.col("p").alias("pu")), "u").join(moved.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        own = cut_lineage(step.filter(F.col("pu") != F.col("pv")).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        if own.isEmpty():
            return roots
