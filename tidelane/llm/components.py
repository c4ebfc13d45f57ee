"""Connected components of an undirected graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.checkpoints import Tables


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Alternates two steps until only stars are left: every node hands its larger neighbours to
    the smallest node around it, then its smaller ones.  Each step keeps the components,
    needs one aggregation and one join, and never gathers a node's neighbours; the number of
    steps grows with the logarithm of the longest path.  Of the written steps only the last stays.
    """
    tables = Tables(edges.sparkSession)
    order = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()

    def stars(df: DataFrame) -> bool:
        """Whether no node has two smaller neighbours, or one beside larger ones."""
        ends = df.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("low")), F.struct(F.col("v").alias("node"), F.lit(1).alias("low")))))
        each = ends.groupBy("node").agg(F.sum("low").alias("lower"), F.min("low").alias("least"))
        return not each.agg(F.max((F.col("lower") > 1) | ((F.col("lower") > 0) & (F.col("least") == 0)))).first()[0]

    now, step = tables.keep("0", order(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))), 0
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = order(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(least, "v")
        small = linked.select(F.col("m").alias("u"), "v").unionByName(linked.select(F.col("m").alias("u"), F.col("u").alias("v")))
        step += 1
        now = tables.keep(str(step), order(small))
        tables.drop(str(step - 1))
    pairs = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
