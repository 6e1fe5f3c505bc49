"""Overlapping clusters of the nodes of many graphs, by joins: a graph may have any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import Workspace, small
from . import graph as gr
from .components import growth, spanning_forest


def clusters(edges: DataFrame, keys: list[str], weight: str = "weight", tau: float = 0.7, window: int = 3, min_weight: float = 0.2, overlap: bool = True, most: int | None = None) -> DataFrame:
    """keys, cluster (the id of its centre), id: clusters of the graphs of edges (keys, src, dst, weight).

    A cluster is what its centre reaches over at most `window` edges of min_weight and more while the product of their
    weights, at its greatest, stays at tau or above. Every node is a centre, or the `most` of each graph with most edges
    (ties: the lesser id). Nodes in no cluster then join that of their strongest edge into one (ties: the lesser
    centre), or are their own. With overlap, a cluster that shares no node with another takes in the nodes
    of the one to which the weights of its edges sum up highest (ties: the lesser centre), all such clusters at once. Contained
    clusters stay. Edges with null ends or weights are ignored; of repeated ones the strongest counts.
    """
    space = Workspace(edges.sparkSession, "clusters")
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    whole = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col(weight).isNotNull())
    once = whole.groupBy(F.least(node("src"), node("dst")).alias("src"), F.greatest(node("src"), node("dst")).alias("dst")).agg(F.max(weight).cast("double").alias("weight"))
    e = space.write(once).df
    both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    nodes = space.write(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
    centers = nodes.df.select("id")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(*[F.col(f"id.{k}") for k in keys]).orderBy(F.col("degree").desc(), "id"))
        centers = nodes.df.withColumn("r", rank).where(F.col("r") <= most).select("id")
    members = space.write(growth(centers, e, tau, window, min_weight).select("center", "id"))
    if most is not None:
        left = nodes.df.select("id").join(members.df.select("id"), "id", "left_anti")
        into = left.withColumnRenamed("id", "src").join(both, "src").join(members.df.select("center", F.col("id").alias("dst")), "dst")
        best = into.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "center")).alias("b"))
        joined = left.join(best, "id", "left").select(F.coalesce("b.center", "id").alias("center"), "id")
        members = space.write(members.df.unionAll(joined))
    found = members.df
    if overlap:
        shared = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        alone = found.select("center").distinct().join(found.join(shared, "id", "left_semi").select("center"), "center", "left_anti")
        alone = space.write(alone)
        mine = found.join(small(alone.df, alone.rows), "center", "left_semi")
        out = mine.withColumnRenamed("id", "src").join(both, "src").join(found.select(F.col("center").alias("other"), F.col("id").alias("dst")), "dst").where("center <> other")
        sums = out.groupBy("center", "other").agg(F.sum("weight").alias("w"))
        nearest = sums.groupBy("center").agg(F.min(F.struct((-F.col("w")).alias("w"), "other")).alias("n")).select("center", F.col("n.other").alias("other"))
        taken = nearest.join(found.withColumnRenamed("center", "other"), "other").select("center", "id")
        found = found.unionAll(taken).distinct()
    return found.select(*[F.col("center")[k].alias(k) for k in keys], F.col("center")["id"].alias("cluster"), F.col("id")["id"].alias("id"))


def connected_neighbours(features: DataFrame, keys: list[str], id_col: str, vector: str, k: int = 1) -> DataFrame:
    """keys, src < dst, weight: the edges to the k most similar of each, and the strongest ones that connect what they leave apart."""
    space = Workspace(features.sparkSession, "neighbours")
    similar = space.write(gr.all_similarities(features, keys, id_col, vector)).df
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    tree = spanning_forest(features.where(F.col(vector).isNotNull()).select(node(id_col).alias("id")), similar.select(node("src").alias("src"), node("dst").alias("dst"), "weight"))
    tree = tree.select(*[F.col("src")[c].alias(c) for c in keys], F.col("src")["id"].alias("src"), F.col("dst")["id"].alias("dst"), "weight")
    return gr.strongest(similar, keys, k).select(*keys, "src", "dst", "weight").unionAll(tree).distinct()


def chunks_by_similarity(features: DataFrame, keys: list[str], id_col: str, vector: str, k: int = 1, **options) -> DataFrame:
    """keys, cluster, id: overlapping chunks of a sequence whose images look alike, from its connected neighbour graph."""
    return clusters(connected_neighbours(features, keys, id_col, vector, k), keys, **options)
