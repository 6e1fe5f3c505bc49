"""Registration of point sets and trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..scale import Workspace
from . import clouds
from .nearest import _finite, nearest_by_grids, nearest_k

SIM3 = "s double, r array<double>, t array<double>"


def moments(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n and the 16 sums of Sim(3) over pairs (x, y, z) -> (u, v, w): partial sums before any shuffle."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w).alias("n")] + [F.sum(w * F.col(c)).alias(f"s_{c}") for c in "xyzuvw"]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a in "uvw" for b in "xyz"]
    sums.append(F.sum(w * (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("s_xx"))
    whole = pairs
    for c in "xyzuvw":
        whole = whole.where(F.col(c).isNotNull())
    return whole.groupBy(*keys).agg(*sums)


def solve(m: dict, scaled: bool = True, signed: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation of one group's moments. signed=False takes the scale from all
    singular values even where the rotation had to be kept from a reflection."""
    n = m["n"]
    x = np.array([m["s_x"], m["s_y"], m["s_z"]]) / n
    y = np.array([m["s_u"], m["s_v"], m["s_w"]]) / n
    cov = np.array([[m[f"s_{a}{b}"] for b in "xyz"] for a in "uvw"]) / n - np.outer(y, x)
    var = m["s_xx"] / n - x @ x
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    r = (u * sign) @ vt
    s = float((d * (sign if signed else 1)).sum() / var) if scaled and var > 0 else 1.0
    return s, r, y - s * r @ x


def similarity(pairs: DataFrame, keys: list[str], scaled: bool = True, weight: Column | None = None) -> DataFrame:
    """keys, s, r (9), t (3): the least-squares s r x + t of pairs; one 3x3 decomposition per group. Groups without pairs give nothing."""
    sums = moments(pairs, keys, weight)
    schema = ", ".join(f"`{k}` {dict(sums.dtypes)[k]}" for k in keys) + ", " + SIM3

    def each(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                s, r, t = solve(row, scaled)
                rows.append({k: row[k] for k in keys} | {"s": s, "r": r.ravel().tolist(), "t": t.tolist()})
            yield pd.DataFrame(rows, columns=[*keys, "s", "r", "t"])

    return sums.mapInPandas(each, schema)


def moved(points: DataFrame, fit: DataFrame, keys: list[str], names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """points with x, y, z moved by the fit of their group (keys, s, r, t)."""
    p = g.apply_similarity(F.col("s"), F.col("r"), F.col("t"), F.array(*[F.col(c) for c in names]))
    return points.join(fit, keys).withColumn("__p", p).withColumns({c: F.get("__p", F.lit(i)) for i, c in enumerate(names)}).drop("__p", "s", "r", "t")


def icp(source: DataFrame, target: DataFrame, keys: list[str], threshold: float = 0.1, rounds: int = 30, cell: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """source moved onto target by rigid point-to-point steps: nearest neighbours within the threshold, then
    the least-squares motion. Each group ends for itself, after `rounds` steps or when its own mean distance
    changes by less than the tolerance, so its result doesn't depend on other groups. Groups without neighbours, and points
    without finite coordinates, stay where they are. A task takes whole groups through all steps; those of over
    clouds.WHOLE_ROWS rows go by joins, a few jobs a step."""
    own, known = source.select(*keys, "idx", "x", "y", "z"), target.select(*keys, "idx", "x", "y", "z")
    for c in keys:
        known = known.where(F.col(c).isNotNull())
    large = clouds.large_groups(own, known, keys)
    (a, big_a), (b, big_b) = (clouds.apart(df, keys, large) for df in (own, known))
    sides = clouds.side_by_side(a, b, keys)
    types, wide = dict(own.dtypes), dict(sides.dtypes)["idx"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in clouds.whole_groups(batches, keys):
            xyz, first = clouds.coordinates(t), t["side"].to_numpy() == 0
            null = {c: t[c].is_null().to_numpy() for c in "xyz"}
            for start, end in zip(starts, starts[1:]):
                middle = start + int(first[start:end].sum())
                xyz[start:middle] = _settled(xyz[start:middle], xyz[middle:end], threshold, rounds, tolerance)
            out = t.select([*keys, "idx"])
            for i, c in enumerate("xyz"):
                out = out.append_column(c, pa.array(xyz[:, i], mask=null[c]))
            yield from out.filter(pa.array(first)).combine_chunks().to_batches()

    done = sides.mapInArrow(each, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", idx {wide}, x double, y double, z double")
    done = done.withColumn("idx", F.col("idx").cast(types["idx"]))
    return done.unionByName(_icp_by_joins(big_a, big_b, keys, threshold, rounds, cell, tolerance)) if large else done


def _settled(source: np.ndarray, target: np.ndarray, threshold: float, rounds: int, tolerance: float) -> np.ndarray:
    """icp of one group's coordinates."""
    whole = lambda p: (np.abs(p) < 1e300).all(1)
    rest, target = whole(source), target[whole(target)]
    x, before = source[rest], np.inf
    if not len(x) or not len(target):
        return source
    tree = clouds.Tree(target) if len(x) * len(target) > 250_000 else None
    for _ in range(rounds):
        at, d = clouds.near(x, target, tree)
        ok = d <= threshold
        if not ok.any():
            break
        mean = d[ok].mean()
        if abs(before - mean) < tolerance:
            break
        _, r, t = fit_similarity(x[ok], target[at[ok]], scaled=False)
        x, before = x @ r.T + t, mean
    out = source.copy()
    out[rest] = x
    return out


def _icp_by_joins(source: DataFrame, target: DataFrame, keys: list[str], threshold: float, rounds: int, cell: float | None, tolerance: float) -> DataFrame:
    """icp of groups too large for one task."""
    space = Workspace(source.sparkSession, "icp")
    start = source.select(*keys, "idx", "x", "y", "z", F.lit(None).cast("double").alias("before"), F.lit(False).alias("settled"))
    moving = F.count_if(~F.col("settled"))
    # Positions are the state of the loop: written, so that plans stay short, with a count of the points that still move.
    now = space.write(start, moving)
    for _ in range(rounds):
        if not now.mark:
            break
        rest = now.df.where(~F.col("settled"))
        near = nearest_by_grids(_finite(rest, keys), _finite(target, keys), keys, cell or threshold, radius=threshold).where(F.col("distance") <= threshold)
        means = near.groupBy(*keys).agg(F.avg("distance").alias("mean"))
        near = near.join(rest, [*keys, "idx"]).join(target.select(*keys, F.col("idx").alias("nn"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), [*keys, "nn"])
        fit = means.join(similarity(near, keys, scaled=False), keys)
        same = F.col("settled") | F.col("mean").isNull() | F.coalesce(F.abs(F.col("before") - F.col("mean")) < tolerance, F.lit(False))
        step = F.when(same, F.array("x", "y", "z")).otherwise(g.apply_similarity(F.col("s"), F.col("r"), F.col("t"), F.array("x", "y", "z")))
        moved_on = now.df.join(fit, keys, "left").withColumn("p", step).withColumn("same", same)
        moved_on = moved_on.select(*keys, "idx", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")], F.col("mean").alias("before"), F.col("same").alias("settled"))
        last, now = now, space.write(moved_on, moving)
        last.drop()
    return now.df.select(*keys, "idx", "x", "y", "z")


def _by_group(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(f, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema)


def normals(points: DataFrame, keys: list[str], k: int = 30) -> DataFrame:
    """keys, idx, nx, ny, nz: the direction of least variance of the k nearest points (the point among them; ties: the lesser
    idx), of any sign. A group of fewer points takes all of them. Points without all coordinates have none.

    Neighbours come from joins of grids of growing cells, as in nearest, so a cloud may have any size; what is made
    of them is ten sums, and one 3x3 decomposition a point."""
    near = nearest_k(points, keys, k)
    at = points.select(*keys, F.col("idx").alias("nn"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    own = points.select(*keys, "idx", *[F.col(c) for c in "xyz"])
    both = near.join(at, [*keys, "nn"]).join(own, [*keys, "idx"])
    d = {c: F.col(f"n{c}") - F.col(c) for c in "xyz"}
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = both.groupBy(*keys, "idx").agg(*[F.avg(d[c]).alias(f"m{c}") for c in "xyz"], *[F.avg(d[a] * d[b]).alias(f"s{a}{b}") for a, b in pairs])
    types = dict(points.dtypes)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cov = np.empty((len(pdf), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                cov[:, i, j] = cov[:, j, i] = pdf[f"s{a}{b}"] - pdf[f"m{a}"] * pdf[f"m{b}"]
            n = np.linalg.eigh(cov)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            yield pdf[[*keys, "idx"]].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])

    return sums.mapInPandas(each, ", ".join(f"`{c}` {types[c]}" for c in [*keys, "idx"]) + ", nx double, ny double, nz double")


def farthest_points(points: DataFrame, keys: list[str], n: int, seed: int | None = None) -> DataFrame:
    """n points of each group with their rank, each the farthest from those before; ties go to the lesser idx. The first is that of the
    least idx, or with a seed one that depends on the seed and the group's size. A group is the cloud of one
    sequence, held by one task; points without all coordinates are left out."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y", "z"]).sort_values("idx")
        p = pdf[["x", "y", "z"]].to_numpy(float)
        if not len(p):
            return pdf.assign(rank=pd.Series(dtype="int32"))
        at = int(np.random.default_rng([seed, len(p)]).integers(len(p))) if seed is not None else 0
        picked, d = [at], ((p - p[at]) ** 2).sum(1)
        while len(picked) < min(n, len(p)):
            d[picked] = -1.0
            at = int(d.argmax())
            picked.append(at)
            d = np.minimum(d, ((p - p[at]) ** 2).sum(1))
        return pdf.iloc[picked].assign(rank=range(len(picked)))

    return points.groupBy(*keys).applyInPandas(each, ", ".join(f"`{c}` {t}" for c, t in points.dtypes) + ", rank int")


def _nn(a: np.ndarray, b: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    at, d = np.zeros(len(a), int), np.zeros(len(a))
    for i in range(0, len(a), chunk):
        q = ((a[i : i + chunk, None] - b[None]) ** 2).sum(-1)
        at[i : i + chunk] = q.argmin(1)
        d[i : i + chunk] = np.sqrt(q.min(1))
    return at, d


def fit_similarity(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted least-squares Sim(3) of arrays (n, 3)."""
    w = np.ones(len(x)) if w is None else w
    m = {"n": w.sum(), "s_xx": (w * (x * x).sum(1)).sum()}
    m |= {f"s_{c}": (w * x[:, i]).sum() for i, c in enumerate("xyz")} | {f"s_{c}": (w * y[:, i]).sum() for i, c in enumerate("uvw")}
    m |= {f"s_{a}{b}": (w * y[:, i] * x[:, j]).sum() for i, a in enumerate("uvw") for j, b in enumerate("xyz")}
    return solve(m, scaled)


def robust_similarity(x: np.ndarray, y: np.ndarray, rounds: int = 20, radius: float | None = None, delta: float = 0.1) -> tuple[float, np.ndarray, np.ndarray]:
    """Sim(3) from x to y without known pairs: mutual neighbours, Huber weights, until the motion settles."""
    s, r, t = 1.0, np.eye(3), np.zeros(3)
    for _ in range(rounds):
        z = s * x @ r.T + t
        f, d = _nn(z, y)
        back, _ = _nn(y, z)
        ok = back[f] == np.arange(len(z))
        if radius is not None:
            ok &= d <= radius
        if ok.sum() < 3:
            break
        w = np.where(d[ok] <= delta, 1.0, delta / np.maximum(d[ok], 1e-12))
        new = fit_similarity(x[ok], y[f[ok]], w)
        change = abs(new[0] - s) + np.abs(new[1] - r).max() + np.abs(new[2] - t).max()
        s, r, t = new
        if change < 1e-9:
            break
    return s, r, t


def refine_similarity(x: np.ndarray, y: np.ndarray, fit: tuple[float, np.ndarray, np.ndarray], delta: float = 0.01, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """The Huber optimum for known pairs, by reweighted least squares from a first fit."""
    s, r, t = fit
    for _ in range(rounds):
        d = np.linalg.norm(s * x @ r.T + t - y, axis=1)
        s, r, t = fit_similarity(x, y, np.where(d <= delta, 1.0, delta / np.maximum(d, 1e-12)))
    return s, r, t


def robust_alignment(source: DataFrame, target: DataFrame, keys: list[str], most: int | None = 10_000, radius: float | None = None) -> DataFrame:
    """keys, s, r, t: robust Sim(3) of two clouds per group, from farthest points where a cloud has over `most`; with None from all
    points, in time that grows with the product of both sizes. Groups of fewer than three points on a side give nothing."""
    plain = lambda df: df.select(*keys, "idx", "x", "y", "z").dropna(subset=["x", "y", "z"])
    taken = lambda df: plain(df).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))) if most is None else farthest_points(plain(df), keys, most)
    a, b = taken(source).withColumn("side", F.lit(0)), taken(target).withColumn("side", F.lit(1))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf.side == k].sort_values("rank")[["x", "y", "z"]].to_numpy(float) for k in (0, 1))
        if min(len(x), len(y)) < 3:
            return pd.DataFrame(columns=[*keys, "s", "r", "t"])
        s, r, t = robust_similarity(x, y, radius=radius)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"s": s, "r": r.ravel().tolist(), "t": t.tolist()}])

    return _by_group(a.unionAll(b), keys, each, SIM3)


def merge_chunks(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, pix, x, y, z, votes: predictions (chunk, frame, pix, x, y, z) of overlapping chunks in the
    coordinates of the first one: each next chunk is aligned by the pixels it shares with what is merged, then
    averaged with one vote a chunk. Order matters, so a sequence is merged in one task."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        merged: pd.DataFrame | None = None
        for _, part in pdf.groupby("chunk", sort=True):
            part = part.set_index(["frame", "pix"])[["x", "y", "z"]]
            if merged is None:
                merged = part.assign(votes=1)
                continue
            common = merged.index.intersection(part.index)
            if len(common) >= 3:
                s, r, t = fit_similarity(part.loc[common].to_numpy(), merged.loc[common, ["x", "y", "z"]].to_numpy())
                part = pd.DataFrame(s * part.to_numpy() @ r.T + t, index=part.index, columns=["x", "y", "z"])
            votes = merged.loc[common, ["votes"]].to_numpy()
            merged.loc[common, ["x", "y", "z"]] = (merged.loc[common, ["x", "y", "z"]].to_numpy() * votes + part.loc[common].to_numpy()) / (votes + 1)
            merged.loc[common, "votes"] += 1
            merged = pd.concat([merged, part.drop(common).assign(votes=1)])
        out = merged.reset_index()
        return pd.concat([pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=out.index), out], axis=1)

    return _by_group(predictions, keys, each, "frame int, pix long, x double, y double, z double, votes int")
