"""Pairwise matches to groups.

The method: peel the giant component by breadth-first frontier joins from the vertex of
highest degree, take it out with an anti-join, and label what remains by minimum propagation.
Links never cross the graphs named by graph_cols, so every graph has a giant component of its
own and all of them are peeled by the same joins.

Vertices get dense ids once; all rounds move longs. Frontiers go to a broadcast only
while their counted rows allow it. A breadth-first join pays while it reaches much: peeling goes on until the
frontier is empty or a round reaches less than one vertex in MUCH of those left, as along a chain of any
length. What it has reached then stands for one vertex and keeps its links to the rest, so the result is exact
for every shape of graph. What remains falls into small components. Graphs with few links left are whole in one
task and propagate minima in arrays; the links of the others propagate them by rounds of joins,
which halve distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import TASK_LINKS, least_of_components, mark_of_links, minimum_propagation
from ..scale import BROADCAST_NAMES, BROADCAST_ROWS, Workspace, Written, attach, small

#: A round of peeling must reach one in so many of the vertices that are left, or it is the last.
MUCH = 20


def consolidate(links: DataFrame, src: str = "src", dst: str = "dst", graph_cols: tuple[str, ...] = (), task_links: int = TASK_LINKS) -> DataFrame:
    """One row per linked name: graph_cols, name, group_name (the smallest name of its group).

    links: a row per link, in any direction, repeated at will; other columns are ignored.
    Links with a null end or from a name to itself relate nothing, and names that have only
    such links don't come out. Null graph columns are a graph of their own. No links give no rows.
    """
    spark = links.sparkSession
    space = Workspace(spark, "consolidate")
    graph = F.struct(*[F.col(c) for c in graph_cols]) if graph_cols else F.struct(F.lit(0).alias("all"))
    ends = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    pairs = ends.select(graph.alias("graph"), F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    pairs = space.write(pairs)

    both = pairs.df.select("graph", F.col("a").alias("name")).unionAll(pairs.df.select("graph", F.col("b").alias("name")))
    vertices = both.groupBy("graph", "name").agg(F.count(F.lit(1)).alias("degree"))
    vertices = space.write(vertices.withColumn("id", F.monotonically_increasing_id()))
    best = F.max_by("id", F.struct("degree", -F.col("id"))).alias("seed")
    seeds = space.write(vertices.df.groupBy("graph").agg(best))  # the seed's id also names the graph from here on
    ids = vertices.df.select("graph", "name", "id")
    coded = pairs.df.join(small(ids.toDF("graph", "a", "src"), vertices.rows, BROADCAST_NAMES), ["graph", "a"])
    coded = coded.join(small(ids.toDF("graph", "b", "dst"), vertices.rows, BROADCAST_NAMES), ["graph", "b"])
    coded = coded.join(small(seeds.df, seeds.rows, BROADCAST_NAMES), "graph").select("src", "dst", "seed")
    coded = space.write(coded)
    pairs.drop()

    reached, ended = _peel(space, seeds, coded.df, vertices.rows)
    rest = _rest(space, coded.df, reached, ended)
    coded.drop()
    labels = _propagate(space, rest, task_links)
    # What was peeled belongs to its seed, whose own root may lie in the rest.
    of_seed = labels.df.select(F.col("id").alias("seed"), F.col("root").alias("root_of_seed"))
    if ended:
        peeled = reached.df.select("id", F.col("seed").alias("root"))
    else:
        of_seed = space.write(of_seed.join(small(seeds.df.select("seed"), seeds.rows), "seed", "left_semi"))
        peeled = _with_roots(reached, of_seed).select("id", F.coalesce("root_of_seed", "seed").alias("root"))
    others = labels.df if ended else labels.df.join(small(seeds.df.select(F.col("seed").alias("id")), seeds.rows), "id", "left_anti")
    named = space.write(others.unionAll(peeled).join(small(vertices.df.select("id", "graph", "name"), vertices.rows, BROADCAST_NAMES), "id"))
    groups = named.df.groupBy("root").agg(F.min("name").alias("group_name"))
    out = attach(named.df, groups, "root", named.rows)
    return out.select(*[F.col("graph")[c].alias(c) for c in graph_cols], "name", "group_name")


def _with_roots(reached: Written, of_seed: Written) -> DataFrame:
    """What was reached with the roots of seeds that have one: a seed may have reached most vertices."""
    if of_seed.rows <= BROADCAST_ROWS:
        return reached.df.join(F.broadcast(of_seed.df), "seed", "left")
    return attach(reached.df, of_seed.df, "seed", reached.rows, "left")


def _peel(space: Workspace, seeds: Written, links: DataFrame, vertices: int) -> tuple[Written, bool]:
    """(id, seed) of all that is reached from the seed of its graph; whether all paths have ended."""
    both = links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seed")).select("src", "dst", "seed")
    levels = [space.write(seeds.df.select(F.col("seed").alias("id"), "seed"))]
    left = vertices - levels[0].rows
    while levels[-1].rows:
        frontier = small(levels[-1].df.select(F.col("id").alias("src")), levels[-1].rows)
        after = both.join(frontier, "src", "left_semi").select(F.col("dst").alias("id"), "seed").distinct()
        for known in levels[-2:]:  # what links to a level lies in it or in one beside it
            after = after.join(small(known.df.select("id"), known.rows), "id", "left_anti")
        levels.append(space.write(after))
        left -= levels[-1].rows
        if levels[-1].rows * MUCH < left:
            break
    whole = levels[0].df
    for level in levels[1:]:
        whole = whole.unionAll(level.df)
    return Written(whole, "", sum(x.rows for x in levels), 0), not levels[-1].rows


def _rest(space: Workspace, links: DataFrame, reached: Written, ended: bool) -> Written:
    """The links outside what was reached (src, dst, seed); if paths have not ended, also those that lead out of it."""
    known = small(reached.df.select(F.col("id").alias("src"), F.lit(True).alias("in_src")), reached.rows)
    if ended:
        return space.write(links.join(known, "src", "left_anti"))
    links = links.join(known, "src", "left").join(known.toDF("dst", "in_dst"), "dst", "left")
    links = links.where("in_src is null or in_dst is null")
    return space.write(links.select(F.when(F.col("in_src"), F.col("seed")).otherwise(F.col("src")).alias("src"), F.when(F.col("in_dst"), F.col("seed")).otherwise(F.col("dst")).alias("dst"), "seed"))


def _propagate(space: Workspace, rest: Written, task_links: int) -> Written:
    """(id, root) of the ends of links."""
    sizes = space.write(rest.df.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_links).select("seed"))
    few, many = rest.df, None
    if sizes.rows:  # at most the number of links over task_links
        large = small(sizes.df, sizes.rows)
        few = rest.df.join(large, "seed", "left_anti")
        ordered = rest.df.join(large, "seed", "left_semi").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        stars = minimum_propagation(space, space.write(ordered.distinct(), mark_of_links()))
        many = stars.df.select(F.col("src").alias("id"), F.col("dst").alias("root"))
        many = many.unionAll(many.select(F.col("root").alias("id"), "root").distinct())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], pa.schema([("seed", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())]))
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)])
            if held.num_rows > 2 * task_links:  # what stays is the graph that the next batch may go on with
                seeds = held.column(0).to_numpy()
                whole = int(np.searchsorted(seeds, seeds[-1]))
                if whole:
                    yield _least(held.slice(0, whole))
                    held = held.slice(whole)
        if held.num_rows:
            yield _least(held)

    tasks = max(1, -(-rest.rows // task_links), rest.df.sparkSession.sparkContext.defaultParallelism if rest.rows > 10_000 else 1)
    done = few.select("seed", "src", "dst").repartition(tasks, "seed").sortWithinPartitions("seed").mapInArrow(each, "id long, root long")
    return space.write(done if many is None else done.unionAll(many))


def _least(links: pa.Table) -> pa.RecordBatch:
    ids, roots = least_of_components(links.column(1).to_numpy(), links.column(2).to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["id", "root"])
