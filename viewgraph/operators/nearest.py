"""Nearest neighbours, mutual ones, and association in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import BROADCAST_NAMES, Workspace, small
from . import clouds


def _finite(df: DataFrame, keys: list[str]) -> DataFrame:
    for c in keys:
        df = df.where(F.col(c).isNotNull())
    for c in "xyz":
        df = df.where(F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(1e300)))
    return df.select(*keys, "idx", "x", "y", "z")


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], cell: float | None = None, radius: float | None = None) -> DataFrame:
    """keys, idx, nn, distance: the nearest of points (keys, idx, x, y, z) to each query of the same group.

    Tasks take whole groups in arrays, after one shuffle. Groups of over clouds.WHOLE_ROWS rows are searched by joins of grids,
    whose first cells have the side given, so a cloud may have any size. Both are exact at any density.
    Ties go to the lesser idx. Queries of groups without points, and queries and
    points with null or infinite coordinates, give nothing. With a radius, neighbours further away give nothing.
    """
    queries, points = _finite(queries, keys), _finite(points, keys)
    large = clouds.large_groups(queries, points, keys)
    (q, big_q), (p, big_p) = (clouds.apart(df, keys, large) for df in (queries, points))
    out = _searched(clouds.side_by_side(q, p, keys), queries, points, keys, 0)
    if large:
        out = out.unionByName(nearest_by_grids(big_q, big_p, keys, cell))
    return out if radius is None else out.where(F.col("distance") <= radius)


def nearest_both(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """nearest(a, b) and nearest(b, a), which share a shuffle where they are part of one plan."""
    a, b = _finite(a, keys), _finite(b, keys)
    large = clouds.large_groups(a, b, keys)
    (p, big_p), (q, big_q) = (clouds.apart(df, keys, large) for df in (a, b))
    sides = clouds.side_by_side(p, q, keys)
    forward, backward = _searched(sides, a, b, keys, 0), _searched(sides, b, a, keys, 1)
    if large:
        forward, backward = forward.unionByName(nearest_by_grids(big_p, big_q, keys)), backward.unionByName(nearest_by_grids(big_q, big_p, keys))
    return forward, backward


def _searched(sides: DataFrame, queries: DataFrame, points: DataFrame, keys: list[str], asking: int) -> DataFrame:
    """Neighbours of the rows of one side among those of the other."""
    types, wide = dict(queries.dtypes), dict(sides.dtypes)["idx"]
    kept = [*keys, "idx"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in clouds.whole_groups(batches, keys):
            xyz, second = clouds.coordinates(t), t["side"].to_numpy()
            ask, at, far = [], [], []
            for start, end in zip(starts, starts[1:]):
                middle = start + int(np.searchsorted(second[start:end], 1))
                (a, b), (c, d) = ((start, middle), (middle, end))[:: -1 if asking else 1]
                if a < b and c < d:
                    which, distance = clouds.near(xyz[a:b], xyz[c:d])
                    ask.append(np.arange(a, b))
                    at.append(which + c)
                    far.append(distance)
            if not ask:
                continue
            ask, at, far = _once(clouds.numbered(t, starts), *map(np.concatenate, (ask, at, far)))
            out = t.select(kept).take(pa.array(ask)).append_column("nn", t["idx"].take(pa.array(at))).append_column("distance", pa.array(far))
            yield from out.combine_chunks().to_batches()

    found = sides.mapInArrow(each, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", idx {wide}, nn {wide}, distance double")
    return found.select(*keys, F.col("idx").cast(types["idx"]), F.col("nn").cast(dict(points.dtypes)["idx"]), "distance")


def _once(number: np.ndarray, ask: np.ndarray, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One answer for each number that asks: rows of one idx count as one query."""
    run = number[ask]
    if (run[1:] == run[:-1]).any():
        by = np.lexsort((at, far, run))
        by = by[np.append(True, np.diff(run[by]) > 0)]
        ask, at, far = ask[by], at[by], far[by]
    return ask, at, far


def nearest_mutual(a: DataFrame, b: DataFrame, keys: list[str], radius: float | None = None) -> DataFrame:
    """mutual() of nearest_both(a, b), without a join: the task that has a group whole finds both directions and keeps their pairs.
    Only groups of over clouds.WHOLE_ROWS rows are searched and paired by joins."""
    a, b = _finite(a, keys), _finite(b, keys)
    large = clouds.large_groups(a, b, keys)
    (p, big_p), (q, big_q) = (clouds.apart(df, keys, large) for df in (a, b))
    out = _paired(clouds.side_by_side(p, q, keys), a, b, keys)
    if large:
        out = out.unionByName(mutual(nearest_by_grids(big_p, big_q, keys), nearest_by_grids(big_q, big_p, keys), keys))
    return out if radius is None else out.where(F.col("distance") <= radius)


def _paired(sides: DataFrame, queries: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, distance of the rows of both sides that are nearest to each other."""
    types, wide = dict(queries.dtypes), dict(sides.dtypes)["idx"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in clouds.whole_groups(batches, keys):
            xyz, second = clouds.coordinates(t), t["side"].to_numpy()
            number, found = clouds.numbered(t, starts), ([], [])
            for start, end in zip(starts, starts[1:]):
                middle = start + int(np.searchsorted(second[start:end], 1))
                if start < middle < end:
                    there, back = clouds.near_both(xyz[start:middle], xyz[middle:end])
                    found[0].append((np.arange(start, middle), there[0] + middle, there[1]))
                    found[1].append((np.arange(middle, end), back[0] + start, back[1]))
            if not found[0]:
                continue
            (ask, at, far), (back_ask, back_at, _) = (_once(number, *map(np.concatenate, zip(*f))) for f in found)
            chosen = np.full(number[-1] + 1, -1)
            chosen[number[back_ask]] = number[back_at]
            both = chosen[number[at]] == number[ask]
            ask, at, far = ask[both], at[both], far[both]
            out = t.select(keys).take(pa.array(ask)).append_column("a", t["idx"].take(pa.array(ask))).append_column("b", t["idx"].take(pa.array(at)))
            yield from out.append_column("distance", pa.array(far)).combine_chunks().to_batches()

    found = sides.mapInArrow(each, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", a {wide}, b {wide}, distance double")
    found = found.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return found.select(*keys, F.col("a").cast(types["idx"]), F.col("b").cast(dict(points.dtypes)["idx"]), "distance")


def nearest_by_grids(queries: DataFrame, points: DataFrame, keys: list[str], cell: float | None = None, radius: float | None = None) -> DataFrame:
    """As nearest, by joins alone. A grid of cells meets the 27 around a query by an equi-join; a neighbour within one cell's side is
    final. Queries left over meet a grid of twice the side, later of four times, and so on until none is left, so the
    result is exact at any density. The first side is cell, or where that is None what gives a group as many cells as points,
    so that a cell holds few of them; grids of later rounds hold only cells near a query that is left.
    With a radius, neighbours further away aren't looked for.
    """
    space = Workspace(queries.sparkSession, "nearest")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(1e300))
    whole = lambda df: df.where(finite("x") & finite("y") & finite("z"))
    points = whole(points).select(*keys, F.col("idx").alias("nn"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    extent = F.greatest(*[F.max(c) - F.min(c) for c in ("px", "py", "pz")])
    side = F.lit(float(cell)) if cell else extent / F.pow(F.count(F.lit(1)).cast("double"), F.lit(1 / 3))
    sides = space.write(points.groupBy(*keys).agg(F.when(side > 0, side).otherwise(1.0).alias("side")))
    known = small(sides.df, sides.rows, BROADCAST_NAMES)
    points = space.write(points.join(known, keys)).df
    left = space.write(whole(queries).select(*keys, "idx", "x", "y", "z").join(known, keys))
    done: DataFrame | None = None
    times, rounds = 1.0, 0
    gap = lambda a, b: F.col(a) - F.col(b)
    while left.rows:
        cut = lambda c, t=times: F.floor(F.col(c) / (F.col("side") * t)).cast("long")
        around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
        asked = left.df.select("*", F.inline(around))
        asked = asked.select(*keys, "idx", "x", "y", "z", (cut("x") + F.col("a")).alias("cx"), (cut("y") + F.col("b")).alias("cy"), (cut("z") + F.col("c")).alias("cz"))
        grid = points.withColumns({"cx": cut("px"), "cy": cut("py"), "cz": cut("pz"), "reach": F.col("side") * times}).drop("side")
        if rounds and left.rows * 27 <= BROADCAST_NAMES:
            grid = grid.join(F.broadcast(asked.select(*keys, "cx", "cy", "cz").distinct()), [*keys, "cx", "cy", "cz"], "left_semi")
        d = F.sqrt(gap("x", "px") * gap("x", "px") + gap("y", "py") * gap("y", "py") + gap("z", "pz") * gap("z", "pz"))
        best = asked.join(grid, [*keys, "cx", "cy", "cz"]).select(*keys, "idx", "nn", "reach", d.alias("distance"))
        best = best.where(F.col("distance") <= F.col("reach")).groupBy(*keys, "idx").agg(F.min(F.struct("distance", "nn")).alias("n"))
        found = space.write(best.select(*keys, "idx", "n.nn", "n.distance"))
        done = found.df if done is None else done.unionAll(found.df)
        left = left.df.join(small(found.df.select(*keys, "idx"), found.rows, BROADCAST_NAMES), [*keys, "idx"], "left_anti")
        if radius is not None:
            left = left.where(F.col("side") * times < radius)
        left = space.write(left)
        times, rounds = times * (2 if rounds < 3 else 4), rounds + 1
    if done is None:
        return left.df.select(*keys, "idx", F.col("idx").alias("nn"), F.lit(0.0).alias("distance"))
    return done if radius is None else done.where(F.col("distance") <= radius)


def nearest_k(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, idx, nn: the k nearest points to each point of its group, itself among them; ties go to the lesser idx. Of a group of fewer
    points all. Exact: a point is done when k points lie within one cell's side; else the side grows."""
    space = Workspace(points.sparkSession, "nearest")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(1e300))
    points = points.where(finite("x") & finite("y") & finite("z")).select(*keys, "idx", "x", "y", "z")
    extent = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    n = F.count(F.lit(1))
    side = extent * F.pow(F.least(F.lit(float(k)), n) / n, F.lit(1 / 3))
    sides = space.write(points.groupBy(*keys).agg(F.when(side > 0, side).otherwise(1.0).alias("side"), F.least(F.lit(k), n).alias("want")))
    whole = space.write(points.join(small(sides.df, sides.rows, BROADCAST_NAMES), keys))
    left, times, done = whole, 1.0, None
    gap = lambda a, b: F.col(a) - F.col(b)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    while left.rows:
        cut = lambda c, t=times: F.floor(F.col(c) / (F.col("side") * t)).cast("long")
        asked = left.df.select("*", F.inline(around))
        asked = asked.select(*keys, "idx", "want", "x", "y", "z", (F.col("side") * times).alias("reach"), (cut("x") + F.col("a")).alias("cx"), (cut("y") + F.col("b")).alias("cy"), (cut("z") + F.col("c")).alias("cz"))
        grid = whole.df.select(*keys, F.col("idx").alias("nn"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), cut("x").alias("cx"), cut("y").alias("cy"), cut("z").alias("cz"))
        d = gap("x", "px") * gap("x", "px") + gap("y", "py") * gap("y", "py") + gap("z", "pz") * gap("z", "pz")
        near = asked.join(grid, [*keys, "cx", "cy", "cz"]).select(*keys, "idx", "want", "nn", "reach", d.alias("d")).where(F.col("d") <= F.col("reach") * F.col("reach"))
        rank = F.row_number().over(Window.partitionBy(*keys, "idx").orderBy("d", "nn"))
        best = space.write(near.withColumn("r", rank).where(F.col("r") <= k).select(*keys, "idx", "nn", "want"))
        ready = space.write(best.df.groupBy(*keys, "idx", "want").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("want")).select(*keys, "idx"))
        found = best.df.join(small(ready.df, ready.rows, BROADCAST_NAMES), [*keys, "idx"], "left_semi").select(*keys, "idx", "nn")
        done = found if done is None else done.unionAll(found)
        left = space.write(left.df.join(small(ready.df, ready.rows, BROADCAST_NAMES), [*keys, "idx"], "left_anti"))
        times *= 2
    return done if done is not None else left.df.select(*keys, "idx", F.col("idx").alias("nn"))


def mutual(forward: DataFrame, backward: DataFrame, keys: list[str], radius: float | None = None) -> DataFrame:
    """keys, a, b, distance where b is the nearest to a and a the nearest to b, within radius if given."""
    f = forward.select(*keys, F.col("idx").alias("a"), F.col("nn").alias("b"), "distance")
    back = backward.select(*keys, F.col("idx").alias("b"), F.col("nn").alias("a"))
    both = f.join(back, [*keys, "a", "b"])
    return both.where(F.col("distance") <= radius) if radius is not None else both


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tolerance: float, unique: bool = False) -> DataFrame:
    """left with the row of right nearest in time (columns of right prefixed r_), within the tolerance.

    Time falls into buckets of the tolerance's length; a row meets its own bucket and the two beside it, so
    the join is by equality. Ties go to the earlier row. With unique, a row of right keeps only its nearest left row.
    Rows with null times have no partner and are left out.
    """
    bucket = lambda c: F.floor(c.cast("double") / tolerance).cast("long")
    a = left.where(F.col(ts).isNotNull()).withColumn("__id", F.monotonically_increasing_id())
    a = a.withColumn("__b", F.explode(F.array(*[bucket(F.col(ts)) + i for i in (-1, 0, 1)])))
    names = [c for c in right.columns if c not in keys]
    b = right.where(F.col(ts).isNotNull()).withColumn("__b", bucket(F.col(ts))).select(*keys, "__b", *[F.col(c).alias(f"r_{c}") for c in names])
    gap = F.abs(F.col(f"r_{ts}").cast("double") - F.col(ts).cast("double"))
    near = a.join(b, [*keys, "__b"]).withColumn("gap", gap).where(F.col("gap") <= tolerance)
    rest = [c for c in near.columns if c not in (*keys, "__id", "__b", "gap", f"r_{ts}")]
    best = near.groupBy(*keys, "__id").agg(F.min(F.struct("gap", f"r_{ts}", *[c for c in rest if c in left.columns], *[c for c in rest if c not in left.columns])).alias("n"))
    out = best.select(*keys, "n.*")
    if unique:
        w = Window.partitionBy(*keys, f"r_{ts}").orderBy("gap", ts)
        out = out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out


def voxels(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, i, j, k: the distinct cells of a grid that hold a point."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    return points.where("x is not null and y is not null and z is not null").select(*keys, cell("x").alias("i"), cell("y").alias("j"), cell("z").alias("k")).distinct()


def voxel_iou(a: DataFrame, b: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, n_common, n_union, iou of the occupied cells of two clouds."""
    sides = voxels(a, keys, size).withColumn("s", F.lit(1)).unionAll(voxels(b, keys, size).withColumn("s", F.lit(2)))
    cells = sides.groupBy(*keys, "i", "j", "k").agg(F.sum("s").alias("s"))
    out = cells.groupBy(*keys).agg(F.count_if(F.col("s") == 3).alias("n_common"), F.count(F.lit(1)).alias("n_union"))
    return out.withColumn("iou", F.col("n_common") / F.col("n_union"))


def knn(vectors: DataFrame, id_col: str, vector: str, k: int, block: int = 16_384) -> DataFrame:
    """id, neighbour, similarity: the k most similar others of every row by cosine, ties to the lesser id.

    Rows come in blocks; every task compares a pair of blocks by one matrix product and keeps the k
    best of each row, which are merged by id. Work is quadratic as the question is, and so is what is shuffled, by the
    number of blocks: every row meets every block. Memory is two blocks a task, so a larger block costs memory and saves shuffle.
    Rows with a null id or vector take no part.
    """
    whole = vectors.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    parts = max(1, -(-whole.count() // block))
    rows = whole.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = rows.select("id", "v", F.col("p").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.lit(0).alias("side"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        va, vb = (np.stack(x["v"].to_numpy()).astype(float) for x in (a, b))
        va /= np.linalg.norm(va, axis=1, keepdims=True) + 1e-6
        vb /= np.linalg.norm(vb, axis=1, keepdims=True) + 1e-6
        s = va @ vb.T
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        s[ia[:, None] == ib[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"id": np.repeat(ia, top.shape[1]), "neighbour": ib[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()})
        return out[np.isfinite(out["similarity"])]

    near = left.unionAll(right).groupBy("i", "j").applyInPandas(best, "id long, neighbour long, similarity double")
    merged = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k).alias("n"))
    return merged.select("id", F.explode("n").alias("n")).select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.s")).alias("similarity"))


def within(distance: Column, radius: Column | float) -> Column:
    return F.coalesce(distance <= radius, F.lit(False))
