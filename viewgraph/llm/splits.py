"""Splits that keep related records together.

The method: distributed union-find. Tasks turn the links they hold into local forests, which
are merged level by level: where several forests hold a vertex, their roots become linked, and
only those links go up to fewer tasks. No task holds more than a chunk of links at a time. Then
groups go, largest first, to the split furthest below its target.

The last step is sequential only over distinct group sizes: N records have fewer than
sqrt(2 N) + 1 of them, each with a count, and that table is all the driver sees. Groups of one size
are told apart by their rank alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Workspace, Written, attach, numbered_within

#: Links that a task holds at a time.
CHUNK_LINKS = 2_000_000
#: Forests merged into one task at the next level.
FAN_IN = 8


def local_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex of the tree of each), by union-find over arrays."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    parent = np.arange(len(ids))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return ids, ids[parent]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))  # union by least root
        while (up := parent[parent]).tobytes() != parent.tobytes():  # find, with full compression
            parent = up


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    links = 0

    def flush() -> pa.RecordBatch:
        ids, roots = local_forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["id", "root"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            links += batch.num_rows
        if links >= CHUNK_LINKS:
            yield flush()
            held, links = [], 0
    if held:
        yield flush()


def union_find(space: Workspace, links: Written, parts: int | None = None) -> Written:
    """(id, root): every vertex of links (src, dst longs) with the least vertex of its component.

    Level k has one task for FAN_IN^k of the first level's, but never more than a chunk of links a
    task. Each level removes at least the vertices that are no root anywhere, so levels are few.
    """
    parts = parts or max(1, -(-links.rows // CHUNK_LINKS) * 4)
    parents: list[Written] = []
    every: Written | None = None
    now = links
    while now.rows:
        stars = now.df.select("src", "dst").repartition(max(parts, -(-now.rows // CHUNK_LINKS)), "src", "dst").mapInArrow(_forests, "id long, root long")
        # A vertex is in one star of a chunk, so its set of roots has no more entries than there are chunks.
        merged = space.write(stars.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots")))
        every = every or merged
        is_root = F.array_contains("roots", F.col("id"))
        parents.append(space.write(merged.df.where(~is_root).select("id", F.element_at("roots", 1).alias("root"))))
        up = merged.df.where(F.size("roots") > 1).select(F.explode(F.slice("roots", 2, 1 << 30)).alias("src"), F.element_at("roots", 1).alias("dst")).distinct()
        now = space.write(up)
        parts = max(1, parts // FAN_IN)
    labels: Written | None = None
    for level in reversed(parents):
        if labels is None:
            labels = level
            continue
        above = labels.df.select(F.col("id").alias("root"), F.col("root").alias("top"))
        resolved = attach(level.df, above, "root", level.rows, "left").select("id", F.coalesce("top", "root").alias("root"))
        labels = space.write(resolved.unionAll(labels.df))
    if labels is None or every is None:
        return Written(links.df.select(F.col("src").alias("id"), F.col("dst").alias("root")), "", 0, 0)
    roots = every.df.select("id").join(labels.df.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
    return Written(labels.df.unionAll(roots), "", every.rows, 0)


def related_groups(entries: DataFrame, name: str, keys: dict[str, Column]) -> DataFrame:
    """(name, group_name): every name with the smallest name of those it is related to.

    Names are related if rows of theirs agree in any of the keys, directly or through others;
    a null key relates nothing. A name of several rows has the keys of all of them. Null names
    give no rows and relate nothing. No rows give no rows.
    """
    space = Workspace(entries.sparkSession, "groups")
    key = F.explode(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k + ":"), c)) for k, c in keys.items()]))
    held = entries.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), key.alias("key")).distinct()
    held = space.write(held)
    names = held.df.groupBy("name").agg(F.count("key").alias("n")).select("name", F.lit(None).cast("string").alias("key"))
    of_key = held.df.where(F.col("key").isNotNull()).select("key").distinct().select(F.lit(None).cast("string").alias("name"), "key")
    vertices = space.write(names.unionAll(of_key).withColumn("id", F.monotonically_increasing_id()))
    name_ids = vertices.df.where(F.col("name").isNotNull()).select("name", F.col("id").alias("src"))
    key_ids = vertices.df.where(F.col("key").isNotNull()).select("key", F.col("id").alias("dst"))
    links = attach(held.df.where(F.col("key").isNotNull()), key_ids, "key", held.rows).join(name_ids, "name").select("src", "dst")
    found = union_find(space, space.write(links))
    labelled = name_ids.withColumnRenamed("src", "id").join(found.df, "id", "left").select("name", F.coalesce("root", "id").alias("root"))
    labelled = space.write(labelled)
    groups = labelled.df.groupBy("root").agg(F.min("name").alias("group_name"))
    return attach(labelled.df, groups, "root", labelled.rows).select("name", "group_name")


def greedy_shares(sizes: list[tuple[int, int]], targets: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, end rank): what largest-first assignment gives each split.

    sizes: (size, number of groups). targets: proportions, scaled to a sum of 1. Each group goes to
    the split furthest below its target in records; ties go to the split named first. Of one
    size, all but the last few groups are handed out at once: the c greatest terms of the sequences
    deficit, deficit - size, deficit - 2 size, ... of the splits are what one by one would take.
    """
    total = sum(s * c for s, c in sizes)
    whole = sum(targets.values())
    names = list(targets)
    if not names or whole <= 0:
        return []
    lack = [targets[x] / whole * total for x in names]
    out = []
    for size, count in sorted(sizes, reverse=True):
        given = [0] * len(names)
        if count > 1000:
            low, high = min(lack) - size * count, max(lack)
            for _ in range(100):  # the level above which fewer than count terms lie
                mid = (low + high) / 2
                low, high = (low, mid) if sum(max(0, int((x - mid) // size)) for x in lack) < count else (mid, high)
            given = [max(0, int((x - high) // size)) for x in lack]
        heap = [(-(x - size * g), i) for i, (x, g) in enumerate(zip(lack, given))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            deficit, i = heap[0]
            heapq.heapreplace(heap, (deficit + size, i))
            given[i] += 1
        at = 0
        for i, g in enumerate(given):
            lack[i] -= size * g
            if g:
                out.append((size, names[i], at, at + g))
            at += g
    return out


def assign_splits(groups: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(name, group_name, split) for (name, group_name): all names of a group in one split, in the
    proportions of targets as far as groups allow. Without targets split is null."""
    space = Workspace(groups.sparkSession, "splits")
    names = space.write(groups)
    sized = space.write(names.df.groupBy("group_name").agg(F.count(F.lit(1)).alias("size")))
    sizes = [(r["size"], r["n"]) for r in sized.df.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]  # < sqrt(2 N) + 1 rows
    shares = greedy_shares(sizes, targets)
    table = groups.sparkSession.createDataFrame(shares, "size long, split string, first long, end long")
    ranked = numbered_within(sized.df, "size", "group_name", sized.rows)
    hit = (F.col("s.size") == F.col("g.size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    split_of = ranked.alias("g").join(F.broadcast(table).alias("s"), hit, "left").select("group_name", "split")
    return attach(names.df, split_of, "group_name", names.rows)
