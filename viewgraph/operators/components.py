"""Connected components, labels and spanning forests of graphs of any size, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Workspace, Written, attach, small

#: Links that one task may hold.
TASK_LINKS = 200_000


def mark_of_links() -> Column:
    """Order-free mark of a table of links, by which a round without change is seen."""
    return F.bit_xor(F.xxhash64("src", "dst"))


def least_of_components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex of the component of each): every vertex takes the least label around it, and labels
    take the labels of what they name, until nothing changes."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        if before.tobytes() == label.tobytes():
            return ids, ids[label]


def _in_one_task(links: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, roots = least_of_components(*(np.concatenate(x) for x in zip(*held)))
            below = ids != roots
            yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(roots[below])], names=["src", "dst"])

    return links.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(each, "src long, dst long")


def minimum_propagation(space: Workspace, links: Written) -> Written:
    """(src, dst): each vertex with a link, but for the least of its component, with that least one.

    links: distinct rows with src > dst and mark_of_links as mark. In each round every vertex hands the least vertex near
    it to its greater neighbours, then to the smaller ones and itself. That keeps components as
    they are and shortens paths to a logarithm of rounds. Rounds end when the links stay the same.

    A vertex may have any share of the links. Minima are aggregated before the shuffle and written, so the join
    that hands them out is either a broadcast (up to BROADCAST_ROWS) or has exchanges on both sides, where
    adaptive execution splits a hot vertex over tasks. TASK_LINKS and fewer propagate in the arrays of one task.
    """
    now = links
    while now.rows:
        if now.rows <= TASK_LINKS:
            return space.write(_in_one_task(now.df))
        there = now.df.unionAll(now.df.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = space.write(there.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")))
        handed = there.where(F.col("dst") > F.col("src")).join(small(least.df, least.rows), "src")
        large = space.write(handed.select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())
        floor = space.write(large.df.groupBy("src").agg(F.min("dst").alias("m")))
        below = large.df.join(small(floor.df, floor.rows), "src").where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        after = space.write(below.unionAll(floor.df.withColumnRenamed("m", "dst")).distinct(), mark_of_links())
        same = (after.rows, after.mark) == (now.rows, now.mark)
        for written in (now, least, large, floor):
            written.drop()
        now = after
        if same:
            break
    return now


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): every vertex with the least id of those it is connected to.

    vertices (id) and edges (src, dst) have ids of any one comparable type. Edges with a null end are
    ignored, and vertices of edges that are missing in vertices are added. A vertex without edges is its own component.
    Ids that are no longs are numbered first, so that rounds move pairs of longs.
    """
    space = Workspace(edges.sparkSession, "components")
    ends = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    links = space.write(ends.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), mark_of_links())
    if dict(links.df.dtypes)["src"] in ("bigint", "int", "smallint", "tinyint"):
        stars = minimum_propagation(space, links)
        labels = stars.df.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        labels = labels.unionAll(labels.select(F.col("component").alias("id"), "component").distinct())
    else:
        linked = links.df.select(F.col("src").alias("id")).unionAll(links.df.select(F.col("dst").alias("id"))).distinct()
        numbers = space.write(linked.withColumn("n", F.monotonically_increasing_id()))
        coded = attach(attach(links.df, numbers.df.toDF("src", "a"), "src", links.rows), numbers.df.toDF("dst", "b"), "dst", links.rows)
        coded = space.write(coded.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")), mark_of_links())
        stars = minimum_propagation(space, coded)
        roots = numbers.df.join(small(stars.df.toDF("n", "root"), stars.rows), "n", "left").select("id", F.coalesce("root", "n").alias("root"))
        roots = space.write(roots)
        names = roots.df.groupBy("root").agg(F.min("id").alias("component"))
        labels = attach(roots.df, names, "root", roots.rows).select("id", "component")
    alone = vertices.where(F.col("id").isNotNull()).select("id").distinct().join(labels.select("id"), "id", "left_anti")
    return labels.unionAll(alone.select("id", F.col("id").alias("component")))


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size)."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_components(components: DataFrame, n: int = 1) -> DataFrame:
    """The ids of the n largest components, with component and size; ties go to the lesser component."""
    best = component_sizes(components).orderBy(F.col("size").desc(), "component").limit(n)
    return components.join(F.broadcast(best) if n <= 10_000 else best, "component").select("id", "component", "size")


def spanning_forest(vertices: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges (src < dst, weight) of the maximum spanning forest, by rounds in which every component
    takes its strongest edge out (Boruvka's method). Equal weights are told apart by src, then dst."""
    space = Workspace(edges.sparkSession, "forest")
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & F.col(weight).isNotNull())
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(weight).alias("weight"))
    edges_now = space.write(e)
    labels = vertices.select("id", F.col("id").alias("component")).distinct()
    chosen: DataFrame | None = None
    while edges_now.rows:
        a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
        out = edges_now.df.join(a, "src").join(b, "dst").where("ca <> cb")
        out = space.write(out)
        if not out.rows:
            break
        best = F.max_by(F.struct("src", "dst", "weight"), F.struct("weight", "src", "dst")).alias("e")
        picks = out.df.groupBy(F.col("ca").alias("c")).agg(best).unionAll(out.df.groupBy(F.col("cb").alias("c")).agg(best))
        picks = picks.groupBy("c").agg(F.max_by("e", F.struct("e.weight", "e.src", "e.dst")).alias("e")).select("e.*").distinct()
        picks = space.write(picks)
        chosen = picks.df if chosen is None else chosen.unionAll(picks.df)
        joined = out.df.join(picks.df.select("src", "dst"), ["src", "dst"]).select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        tops = labels.select(F.col("component").alias("id")).distinct()
        merged = connected_components(tops, joined).select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = space.write(labels.join(merged, "component").select("id", F.col("top").alias("component"))).df
        edges_now = space.write(out.df.select("src", "dst", "weight"))
    if chosen is None:
        return edges_now.df.select("src", "dst", "weight").limit(0)
    return chosen


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5, weight: str = "weight") -> DataFrame:
    """(id, community) after rounds in which each vertex takes the label of the greatest total weight
    around it, its own included with the weight of its strongest edge; ties go to the lesser label."""
    space = Workspace(edges.sparkSession, "labels")
    both = edges.select("src", "dst", F.col(weight).alias("w")).unionAll(edges.select(F.col("dst"), F.col("src"), F.col(weight)))
    both = space.write(both.where("src <> dst")).df
    own = both.groupBy(F.col("src").alias("id")).agg(F.max("w").alias("w"))
    labels = vertices.select("id", F.col("id").alias("community")).distinct()
    for _ in range(rounds):
        heard = both.join(labels.toDF("dst", "community"), "dst").select(F.col("src").alias("id"), "community", "w")
        kept = labels.join(own, "id").select("id", "community", "w")
        votes = heard.unionAll(kept).groupBy("id", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("w"), "community")).alias("v")).select("id", F.col("v.community"))
        labels = space.write(labels.select("id").join(best, "id", "left").select("id", F.coalesce("community", "id").alias("community"))).df
    return labels


def growth(centers: DataFrame, edges: DataFrame, tau: float, hops: int, min_weight: float = 0.0) -> DataFrame:
    """(center, id, strength, depth): what is reached from a center by at most `hops` edges of at least
    min_weight whose product of weights stays at tau or above, with its greatest product."""
    space = Workspace(edges.sparkSession, "growth")
    both = edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst"), F.col("src"), "weight")).where(F.col("weight") >= min_weight)
    both = space.write(both.where("src <> dst")).df
    start = centers.select(F.col("id").alias("center"), "id", F.lit(1.0).alias("strength"), F.lit(0).alias("depth"))
    known = space.write(start)
    frontier = known
    for depth in range(1, hops + 1):
        step = frontier.df.withColumnRenamed("id", "src").join(both, "src")
        step = step.select("center", F.col("dst").alias("id"), (F.col("strength") * F.col("weight")).alias("strength")).where(F.col("strength") >= tau)
        best = step.groupBy("center", "id").agg(F.max("strength").alias("strength"))
        better = best.join(known.df.select("center", "id", F.col("strength").alias("had")), ["center", "id"], "left").where("had is null or strength > had")
        frontier = space.write(better.select("center", "id", "strength", F.lit(depth).alias("depth")))
        if not frontier.rows:
            break
        rest = known.df.join(small(frontier.df.select("center", "id"), frontier.rows), ["center", "id"], "left_anti")
        known = space.write(rest.unionAll(frontier.df))
    return known.df
