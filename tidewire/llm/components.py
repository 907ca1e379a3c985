"""Connected components of a graph given as rows, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it can reach.

    Every round each root takes its smallest neighbouring root if that is smaller than itself; chains of such
    choices are then halved until all point to their end, and edges are rewritten to those roots. Edges inside a
    root vanish. Smallest neighbours are aggregated before the shuffle, so a node with very many edges is one row
    for each task.
    """
    both = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = stored(both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
                    .withColumn("component", F.col("node")), "labels")
    live = both
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        least = (live.union(live.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
                 .select(F.col("a").alias("root"), F.least("a", "b").alias("parent")))
        least = settled(least)
        labels = stored(labels.join(least.withColumnRenamed("root", "component"), "component", "left")
                        .select("node", F.coalesce("parent", "component").alias("component")), "labels")
        to = least.select(F.col("root").alias("a"), F.col("parent").alias("a2"))
        live = stored(live.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("a2").alias("b2")), "b")
                      .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(),
                      "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def settled(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Follows parents (root, parent), parent <= root, to their end, halving the way each round."""
    links = stored(links, "links")
    for _ in range(max_rounds):
        up = links.select(F.col("root").alias("parent"), F.col("parent").alias("next"))
        more = links.where("root <> parent").join(up, "parent").where("next <> parent")
        if more.isEmpty():
            return links
        links = stored(links.join(up, "parent", "left").select("root", F.coalesce("next", "parent").alias("parent")), "links")
    raise RuntimeError(f"parents did not settle in {max_rounds} rounds")
