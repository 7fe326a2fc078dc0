"""Connected components of a table of links, by contraction; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links (a, b) to (v, root): the smallest vertex of its component for each vertex that has a link.

    Each round points every vertex to its smallest neighbour, follows the pointers twice and
    contracts the links; a round leaves at most half of the vertices, mostly far fewer.
    """
    spark = tables.spark
    edges = tables.write(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    for i in range(64):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select(F.col("b"), F.col("a")))
        near = tables.write(both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("p")), f"near{i}")
        up = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = tables.write(near.join(up, "p").select("u", F.col("pp").alias("p")), f"jump{i}")
        moved = edges.join(jump.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(jump.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        fewer = tables.write(moved.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"edges{i}")
        if label is None:
            new = jump.select(F.col("u").alias("v"), F.col("p").alias("root"))
        else:
            new = tables.write(label.join(jump.select(F.col("u").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), f"label{i}")
            tables.drop(label, jump)
        tables.drop(edges, near)
        label, edges = new, fewer
    else:
        raise RuntimeError("links are left after 64 rounds, of which each halves the vertices at least")
    tables.drop(edges)
    return label if label is not None else spark.createDataFrame([], "v long, root long")
