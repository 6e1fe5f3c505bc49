"""Queries on depth rasters, clouds, trajectories and lists.

Rasters are the 8x8 positive parts of embeddings; clouds are the points of a reconstruction, moved a
little for a prediction; trajectories are the events of a user.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..operators import filters
from ..operators import metrics as mt
from ..operators import nearest as nn
from ..operators import registration as reg
from ..session import table

KEYS = ["scene", "recon"]


def _turn(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k, a = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]), np.radians(degrees)
    return (np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k).tolist()


_TURN = _turn((1.0, 2.0, 3.0), 40.0)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v, u, z in units of a tenth."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    return rows.select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("v"), (F.col("p") % 8).alias("u"), (F.greatest(F.col("e").cast("double"), F.lit(0.0)) * 10).alias("z"))


def _positive(e: pd.Series) -> pd.Series:
    return e.map(lambda a: (np.maximum(np.asarray(a, np.float64), 0) * 10).astype("<f4").tobytes())


def _classes(e: pd.Series) -> pd.Series:
    """Classes by the pixel's place: sky on top, ground below, objects between."""
    return e.map(lambda a: np.repeat([2, 2, 12, 12, 15, 15, 1, 1], 8).astype("<i4").tobytes())


def _raised(e: pd.Series) -> pd.Series:
    """Depths from 10 on, a few of them missing: smooth enough for the whole chain to leave something."""
    return e.map(lambda a: np.where(np.asarray(a, np.float64) > -0.25, 10 + 10 * np.abs(np.asarray(a, np.float64)), 0).astype("<f4").tobytes())


def _rasters(spark: SparkSession, sf_dir: str, raised: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    values = F.pandas_udf(_raised if raised else _positive, "binary")("embedding")
    return rows.select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), values.alias("data"), F.pandas_udf(_classes, "binary")("embedding").alias("classes"))


def _stats(data: pd.Series) -> pd.DataFrame:
    arrays = [np.frombuffer(x, "<f4").astype(float) for x in data]
    return pd.DataFrame({"kept": [int((a > 0).sum()) for a in arrays], "total": [float(a.sum()) for a in arrays]})


def _left_by(kernel, classes: bool = False, raised: bool = False):
    """A query: how many pixels a kernel leaves, and their sum."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        udf, stats = raster.raster_udf(kernel, classes), F.pandas_udf(_stats, "kept int, total double")
        out = udf("h", "w", "data", "classes") if classes else udf("h", "w", "data")
        rows = _rasters(spark, sf_dir, raised).select("vec_id", out.alias("data")).select("vec_id", stats("data").alias("s"))
        return rows.select("vec_id", "s.kept", F.round("s.total", 3).alias("total"))

    return query


def depth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters with under half of their pixels valid don't pass."""
    shares = filters.coverage(_pixels(spark, sf_dir), ["vec_id"])
    images = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return filters.covered(images, shares, ["vec_id"], 0.5)


def percentile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.percentile_cut(_pixels(spark, sf_dir), ["vec_id"])
    return out.groupBy("vec_id").agg(F.count_if(F.col("z") > 0).alias("kept"), F.round(F.sum("z"), 6).alias("total"))


def prior_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth of a vector against that of the next one in its label as prior."""
    p = _pixels(spark, sf_dir)
    prior = p.select((F.col("vec_id") - 1).alias("vec_id"), "v", "u", F.col("z").alias("prior"))
    rows = p.join(prior, ["vec_id", "v", "u"]).withColumn("ok", F.col("u") != 7)
    out = filters.prior_filter(rows, ["vec_id"])
    return out.groupBy("vec_id").agg(F.count_if(F.col("z") > 0).alias("kept"), F.round(F.sum("z"), 6).alias("total"))


gradient_cut = _left_by(lambda z: raster.cut_gradient(z.astype(float), 30.0))
median_cut = _left_by(lambda z: raster.cut_unstable(z.astype(float), 5.0))
sparse_object_cut = _left_by(raster.cut_sparse_objects, True)
small_component_cut = _left_by(lambda z: raster.cut_small(z, 2))
cleaned_depth = _left_by(lambda z, c: raster.clean(z.astype(float), c, least_pixels=2), True, True)
depth_edge_mask = _left_by(lambda z: np.where(raster.depth_edges(z.astype(float), rtol=0.5), z, 0))


def _depth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("pred"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("gt"))
    return items.join(parts, "l_partkey").select(F.col("l_returnflag").alias("seq"), "pred", "gt")


def depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.depth_errors(_depth_pairs(spark, sf_dir), ["seq"])
    return out.select("seq", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("seq", "valid")], "valid")


def depth_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and shift by median and by least squares."""
    pairs = _depth_pairs(spark, sf_dir)
    m = mt.depth_scale(pairs, ["seq"], "median").select("seq", F.round("s", 6).alias("s_median"))
    q = mt.depth_scale(pairs, ["seq"], "lstsq").select("seq", F.round("s", 6).alias("s_lstsq"), F.round("t", 4).alias("t_lstsq"))
    return m.join(q, "seq")


def depth_scale_irls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least absolute scale after three rounds of reweighting."""
    return mt.depth_scale(_depth_pairs(spark, sf_dir), ["seq"], "irls", 3).select("seq", F.round("s", 6).alias("s"))


def depth_scale_lad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and shift after a round of reweighting from least squares."""
    return mt.depth_scale(_depth_pairs(spark, sf_dir), ["seq"], "lad", 1).select("seq", F.round("s", 6).alias("s"), F.round("t", 3).alias("t"))


def confidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of events by their value between two quantiles of the user."""
    out = mt.confidence_weights(_walk(spark, sf_dir), ["seq"], "value")
    return out.select("seq", "event_id", F.round("weight", 6).alias("weight"))


def first_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user with a value over its user's mean of 50."""
    rows = _walk(spark, sf_dir).withColumns({"o": F.struct("us", "event_id"), "ok": F.col("value") > 50})
    return mt.first_visible(rows, ["seq"], "o", "event_id", "ok")


def lab_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with their colour in Lab, and back in bytes."""
    from ..functions.color import lab_to_rgb, rgb_to_lab

    rgb = [F.get("rgb", F.lit(i)).cast("double") for i in range(3)]
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "rgb").distinct()
    rows = rows.select(*KEYS, "point3d_id", *[c.alias(n) for n, c in zip("lab", rgb_to_lab(*rgb))])
    back = lab_to_rgb(F.col("l"), F.col("a"), F.col("b"))
    return rows.select(*KEYS, "point3d_id", *[F.round(c, 5).alias(c) for c in "lab"], *[c.alias(n) for n, c in zip(("red", "green", "blue"), back)])


def aligned_depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _depth_pairs(spark, sf_dir)
    out = mt.depth_errors(mt.align_depth(pairs, mt.depth_scale(pairs, ["seq"], "lstsq"), ["seq"], 1e-5), ["seq"])
    return out.select("seq", F.round("abs_rel", 6).alias("abs_rel"), F.round("rmse", 4).alias("rmse"), F.round("d1", 6).alias("d1"), "valid")


# Clouds


def _clouds(spark: SparkSession, sf_dir: str, repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The true cloud and a predicted one: every point, a little larger, shifted, and off by up to 0.05, as its id has it.
    repeated: with repeated rows as they are, for operators in which they change nothing."""
    rows = table(spark, sf_dir, "point3d").select(*KEYS, F.col("point3d_id").alias("idx"), "xyz")
    rows = rows if repeated else rows.distinct()
    x, y, z = (F.get("xyz", F.lit(i)) for i in range(3))
    off = lambda n: ((F.col("idx") * n) % 101) / 1000 - 0.05
    gt = rows.select(*KEYS, "idx", x.alias("x"), y.alias("y"), z.alias("z"))
    pred = rows.select(*KEYS, "idx", (x * 1.01 + 0.02 + off(37)).alias("x"), (y * 1.01 - 0.03 + off(59)).alias("y"), (z * 1.01 + off(83)).alias("z"))
    return gt, pred


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gt, pred = _clouds(spark, sf_dir, repeated=True)
    return nn.nearest_both(pred, gt, KEYS)


def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest true point to every predicted one."""
    gt, pred = _clouds(spark, sf_dir)
    return nn.nearest(pred, gt, KEYS).select(*KEYS, "idx", "nn", F.round("distance", 6).alias("distance"))


def cloud_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.reconstruction_summary(*_neighbours(spark, sf_dir), KEYS)
    return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in out.columns if c not in KEYS])


def mutual_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _clouds(spark, sf_dir, repeated=True)  # rows of one idx are one query there, so nothing is shuffled to fold them
    return nn.nearest_mutual(pred, gt, KEYS, 0.5).select(*KEYS, "a", "b", F.round("distance", 6).alias("distance"))


def voxel_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nn.voxel_iou(*_clouds(spark, sf_dir), KEYS, 1.0)
    return out.select(*KEYS, "n_common", "n_union", F.round("iou", 6).alias("iou"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _clouds(spark, sf_dir)
    return pred.join(gt.toDF(*KEYS, "idx", "u", "v", "w"), [*KEYS, "idx"])


def similarity_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reg.moments(_pairs(spark, sf_dir), KEYS)
    return m.select(*KEYS, *[F.round(c, 6).alias(c) for c in m.columns if c not in KEYS])


def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Sim(3) from a predicted cloud, with its errors, to the true one turned by 40 degrees about an oblique axis and moved."""
    turned = [sum((F.col(c) * k for c, k in zip("uvw", row)), F.lit(0.0)) + t for row, t in zip(_TURN, (3.0, -1.0, 2.0))]
    pairs = _pairs(spark, sf_dir).select(*KEYS, "idx", "x", "y", "z", *[c.alias(n) for n, c in zip("uvw", turned)])
    enough = pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).where("k >= 10").drop("k")
    fit = reg.similarity(pairs.join(enough, KEYS, "left_semi"), KEYS)
    return fit.select(*KEYS, F.round("s", 4).alias("s"), *[F.round(F.get("r", F.lit(i)), 4).alias(f"r{i}") for i in range(9)])


def icp_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance to the nearest true point of each reconstruction's predicted cloud after ICP with its defaults."""
    gt, pred = _clouds(spark, sf_dir)
    done = reg.icp(pred, gt, KEYS)
    return nn.nearest(done, gt, KEYS).groupBy(*KEYS).agg(F.round(F.avg("distance"), 6).alias("residual"))


def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal of every true point, without its sign."""
    gt, _ = _clouds(spark, sf_dir)
    return reg.normals(gt, KEYS).select(*KEYS, "idx", *[F.round(F.abs(c), 3).alias(c) for c in ("nx", "ny", "nz")])


def farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _ = _clouds(spark, sf_dir)
    return reg.farthest_points(gt, KEYS, 16).select(*KEYS, "idx", "rank")


# Trajectories and lists


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("seq"), "event_id", "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").cast("double").alias("us"), "value")


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the view of the same user nearest in time, within an hour."""
    rows = _walk(spark, sf_dir)
    kinds = [r[0] for r in rows.where("event_type is not null").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = rows.where(F.col("event_type") == kinds[0]).select("seq", "event_id", "us")
    right = rows.where(F.col("event_type") == kinds[1]).select("seq", "event_id", "us")
    return nn.asof(left, right, ["seq"], "us", 3.6e9 * 24).select("seq", "event_id", (F.col("gap") / 1e6).alias("gap_s"))


def lagged_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of the change of value between neighbouring events of a user."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("seq").orderBy("us", "event_id")
    d = F.col("value") - F.lag("value").over(w)
    return _walk(spark, sf_dir).withColumn("d", d).groupBy("seq").agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rpe"))


def strided_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _walk(spark, sf_dir).withColumn("o", F.struct("us", "event_id"))
    return filters.stride(rows, ["seq"], "o", 1, 3, 5).select("seq", "event_id")


def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _walk(spark, sf_dir).select("seq", "event_id", "event_type", F.struct("us", "event_id").alias("o"))
    return filters.last_rows(rows, ["seq"], "o").select("seq", "event_id", "event_type")


def macro_and_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over events, and the mean over users of their means."""
    rows = _walk(spark, sf_dir)
    macro = mt.macro_average(rows.groupBy("seq").agg(F.avg("value").alias("value")), ["value"])
    return rows.agg(F.round(F.avg("value"), 6).alias("micro")).crossJoin(macro.select(F.round("value", 6).alias("macro")))


def whole_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of at least 24 images, with the number of images and edges."""
    rows = filters.min_images(table(spark, sf_dir, "sampled_case"), 24)
    return rows.groupBy("sample_uid").agg(F.max(F.size(F.map_keys("imgs"))).cast("long").alias("images"), F.max(F.size("edges")).cast("long").alias("edges"))


def sample_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ordered pairs of a sample's images are linked, each with itself included."""
    rows = table(spark, sf_dir, "sampled_case").where("imgs is not null")
    nodes = rows.select("sample_uid", F.explode(F.map_keys("imgs")).alias("id")).distinct()
    nodes = nodes.select("sample_uid", F.col("id").alias("pos"), "id")
    edges = rows.select("sample_uid", F.inline("edges"))
    from ..operators.samplers import neighbour_mask

    return neighbour_mask(nodes, edges, ["sample_uid"]).groupBy("sample_uid").agg(F.count_if("linked").alias("linked"), F.count(F.lit(1)).alias("pairs"))


def listed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose reconstruction is in a split list."""
    listed = table(spark, sf_dir, "recon_split").select("scene_recon_name").distinct()
    return table(spark, sf_dir, "sampled_case").select("sample_uid", "scene_recon_name").distinct().join(listed, "scene_recon_name", "left_semi")


def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that file headers hold: observations per image and images per track."""
    a = table(spark, sf_dir, "image").select(*KEYS, "image_id", F.size("point3d_ids").alias("n")).distinct().groupBy(*KEYS).agg(F.round(F.avg("n"), 6).alias("mean_observations"))
    b = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", F.size("image_ids").alias("n")).distinct().groupBy(*KEYS).agg(F.round(F.avg("n"), 6).alias("mean_track"))
    return a.join(b, KEYS)


_FUNCTIONS = (
    depth_coverage, percentile_cut, prior_filter, depth_errors, depth_scales, depth_scale_irls, depth_scale_lad, confidence_weights, first_visible, lab_colors, aligned_depth_errors, nearest_points, cloud_accuracy, mutual_points, voxel_iou, similarity_moments, similarity_fit,
    icp_residual, point_normals, farthest_points, asof_events, lagged_motion, strided_events, last_event, macro_and_micro, whole_samples, sample_neighbours, listed_samples, track_lengths,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {
    "gradient_cut": gradient_cut, "median_cut": median_cut, "sparse_object_cut": sparse_object_cut, "small_component_cut": small_component_cut, "cleaned_depth": cleaned_depth, "depth_edge_mask": depth_edge_mask,
}

_PIX = "px AS (SELECT vec_id, label, ((i - 1) // 8)::INT AS v, ((i - 1) % 8)::INT AS u, greatest(embedding[i]::DOUBLE, 0) * 10 AS z FROM embeddings, unnest(range(1, 65)) AS t(i))"
_DEPTHS = "d AS (SELECT l_returnflag AS seq, l_extendedprice / l_quantity AS pred, p_retailprice AS gt FROM lineitem JOIN part ON p_partkey = l_partkey)"
_CLOUD = """
    pt AS (SELECT DISTINCT scene, recon, point3d_id AS idx, xyz FROM point3d),
    gt AS (SELECT scene, recon, idx, xyz[1] AS x, xyz[2] AS y, xyz[3] AS z FROM pt),
    pr AS (SELECT scene, recon, idx, xyz[1]*1.01 + 0.02 + ((idx*37 % 101)/1000::DOUBLE - 0.05::DOUBLE) AS x, xyz[2]*1.01 - 0.03 + ((idx*59 % 101)/1000::DOUBLE - 0.05::DOUBLE) AS y, xyz[3]*1.01 + ((idx*83 % 101)/1000::DOUBLE - 0.05::DOUBLE) AS z FROM pt)"""


def _nn_sql(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT scene, recon, idx, n.nn, n.distance FROM (
        SELECT q.scene, q.recon, q.idx, min({{'distance': sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)), 'nn': p.idx}}) AS n
        FROM {a} q JOIN {b} p USING (scene, recon) GROUP BY ALL))"""


_NN = f"{_CLOUD}, {_nn_sql('f', 'pr', 'gt')}, {_nn_sql('b', 'gt', 'pr')}"
_WALK = "e AS (SELECT user_id AS seq, event_id, event_type, epoch_us(ts)::DOUBLE AS us, value FROM events)"
_SMOOTH, _SLOPE = (1, 4, 6, 4, 1), (-1, -2, 0, 2, 1)


def _mirror(c: str) -> str:
    """Indices outside 0 to 7 mirrored without the edge."""
    return f"(CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END)"


def _mirror_edge(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END)"


_F32 = "f AS (SELECT vec_id, v, u, (z::FLOAT)::DOUBLE AS z FROM px)"
_KERNEL = "w AS (SELECT i - 2 AS o, " + " ".join(["CASE i", *[f"WHEN {i} THEN {s}" for i, s in enumerate(_SMOOTH)], "END AS s, CASE i", *[f"WHEN {i} THEN {s}" for i, s in enumerate(_SLOPE)], "END AS d FROM range(5) t(i))"])
_KEPT = "SELECT vec_id, count_if(z > 0)::INT AS kept, round(sum((z::FLOAT)::DOUBLE), 3) AS total FROM out GROUP BY vec_id"

# One component by flood fill: pixels of the core, then all that are reached from each over four neighbours.
_FLOOD = """core AS (SELECT c.vec_id, c.v, c.u FROM src c JOIN src n ON n.vec_id = c.vec_id AND abs(n.v - c.v) <= 1 AND abs(n.u - c.u) <= 1 AND n.z > 0 GROUP BY ALL HAVING count(*) = 9),
    reach AS (SELECT vec_id, v, u, v AS y, u AS x FROM core UNION
              SELECT r.vec_id, r.v, r.u, c.v, c.u FROM reach r JOIN core c ON c.vec_id = r.vec_id AND abs(c.v - r.y) + abs(c.u - r.x) = 1),
    big AS (SELECT vec_id, v, u FROM reach GROUP BY ALL HAVING count(*) >= 2)"""
_CLASS = "CASE WHEN v < 2 THEN 2 WHEN v < 4 THEN 12 WHEN v < 6 THEN 15 ELSE 1 END"


def _dense(source: str) -> str:
    """Depths of a table, those of classes 12 and 15 gone where under half of the class is valid: each class is one component here."""
    return f"""SELECT s.vec_id, s.v, s.u, CASE WHEN ({_CLASS}) IN (12, 15) AND k.share < 0.5 THEN 0 ELSE s.z END AS z FROM {source} s
        JOIN (SELECT vec_id, {_CLASS} AS class, avg((z > 0)::INT) AS share FROM {source} GROUP BY ALL) k ON k.vec_id = s.vec_id AND k.class = {_CLASS.replace("v <", "s.v <")}"""


def _kernel_sql(name: str, source: str, most: float) -> str:
    return f"""{name} AS (SELECT vec_id, v, u, CASE WHEN sqrt(gx*gx + gy*gy) > {most} THEN 0 ELSE z END AS z FROM (
        SELECT c.vec_id, c.v, c.u, c.z, sum(n.z * a.s * b.d) AS gx, sum(n.z * a.d * b.s) AS gy FROM {source} c, w a, w b, {source} n
        WHERE n.vec_id = c.vec_id AND n.v = {_mirror('c.v + a.o')} AND n.u = {_mirror('c.u + b.o')} GROUP BY ALL))"""


def _median_sql(name: str, source: str, most: float) -> str:
    return f"""o7 AS (SELECT i - 3 AS o FROM range(7) t(i)), {name} AS (SELECT vec_id, v, u, CASE WHEN greatest(abs(z / (m + 1e-8)), abs(m / (z + 1e-8))) > {most} THEN 0 ELSE z END AS z FROM (
        SELECT c.vec_id, c.v, c.u, c.z, median(n.z) AS m FROM {source} c, o7 a, o7 b, {source} n
        WHERE n.vec_id = c.vec_id AND n.v = {_mirror_edge('c.v + a.o')} AND n.u = {_mirror_edge('c.u + b.o')} GROUP BY ALL))"""


SQL = {
    "sparse_object_cut": f"WITH {_PIX}, {_F32}, out AS ({_dense('f')}) {_KEPT}",
    "small_component_cut": f"""
        WITH RECURSIVE {_PIX}, {_F32}, src AS (SELECT * FROM f), {_FLOOD},
        out AS (SELECT f.vec_id, CASE WHEN big.v IS NULL THEN 0 ELSE z END AS z FROM f LEFT JOIN big USING (vec_id, v, u)) {_KEPT}""",
    "cleaned_depth": f"""
        WITH RECURSIVE {_PIX.replace('greatest(embedding[i]::DOUBLE, 0) * 10', 'CASE WHEN embedding[i] > -0.25 THEN 10 + 10 * abs(embedding[i]::DOUBLE) ELSE 0 END')}, {_F32}, {_KERNEL},
        {_kernel_sql('g1', 'f', 50)}, {_median_sql('g2', 'g1', 1.15)}, g3 AS ({_dense('g2')}),
        src AS (SELECT vec_id, v, u, CASE WHEN v < 2 THEN 0 ELSE z END AS z FROM g3), {_FLOOD},
        out AS (SELECT src.vec_id, CASE WHEN big.v IS NULL THEN 0 ELSE z END AS z FROM src LEFT JOIN big USING (vec_id, v, u)) {_KEPT}""",
    # The eigenvector of least variance is that of greatest value of (trace I - C), here by squaring that matrix.
    "point_normals": f"""
        WITH RECURSIVE {_CLOUD},
        k AS (SELECT a.scene, a.recon, a.idx, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM gt a JOIN gt b USING (scene, recon)
              QUALIFY row_number() OVER (PARTITION BY a.scene, a.recon, a.idx ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.idx) <= 30),
        c AS (SELECT scene, recon, idx, {", ".join(f"avg({a}*{b}) - avg({a})*avg({b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM k GROUP BY ALL),
        q AS (SELECT scene, recon, idx, 0 AS i, [[(yy+zz)/t, -xy/t, -xz/t], [-xy/t, (xx+zz)/t, -yz/t], [-xz/t, -yz/t, (xx+yy)/t]] AS a FROM (SELECT *, xx+yy+zz AS t FROM c WHERE xx+yy+zz > 0)
              UNION ALL
              SELECT scene, recon, idx, i + 1, list_transform(s, lambda r: list_transform(r, lambda v: v / (s[1][1] + s[2][2] + s[3][3]))) FROM (
                  SELECT scene, recon, idx, i, list_transform(a, lambda r: list_transform(a, lambda t: list_inner_product(r, t))) AS s FROM q WHERE i < 30)),
        v AS (SELECT scene, recon, idx, list_sort(list_transform(a, lambda r: [list_inner_product(r, r), r[1], r[2], r[3]]), 'DESC')[1] AS r FROM q WHERE i = 30)
        SELECT scene, recon, idx, {", ".join(f"round(abs(r[{i}]) / sqrt(r[1]), 3) AS n{n}" for i, n in ((2, "x"), (3, "y"), (4, "z")))} FROM v""",
    "farthest_points": f"""
        WITH RECURSIVE {_CLOUD},
        r AS (SELECT scene, recon, 0 AS rank, min(idx) AS idx, [min(idx)] AS picked FROM gt WHERE x + y + z IS NOT NULL GROUP BY ALL
              UNION ALL
              SELECT scene, recon, rank, idx, list_append(picked, idx) FROM (
                  SELECT scene, recon, rank + 1 AS rank, picked, arg_max(idx, (d, -idx)) AS idx FROM (
                      SELECT r.scene, r.recon, r.rank, r.picked, p.idx, min((p.x-g.x)*(p.x-g.x) + (p.y-g.y)*(p.y-g.y) + (p.z-g.z)*(p.z-g.z)) AS d
                      FROM r JOIN gt p USING (scene, recon) JOIN gt g ON g.scene = r.scene AND g.recon = r.recon AND list_contains(r.picked, g.idx)
                      WHERE r.rank < 15 AND NOT list_contains(r.picked, p.idx) GROUP BY ALL) GROUP BY ALL))
        SELECT scene, recon, idx, rank::INT AS rank FROM r""",
    "depth_coverage": f"WITH {_PIX} SELECT vec_id, label FROM px GROUP BY ALL HAVING avg((z > 0)::INT) >= 0.5",
    "percentile_cut": f"""
        WITH {_PIX}, c AS (SELECT vec_id, quantile_cont(z, 0.98) AS cut FROM px GROUP BY ALL),
        o AS (SELECT vec_id, CASE WHEN cut > 0 AND z > cut THEN 0 ELSE z END AS z FROM px JOIN c USING (vec_id))
        SELECT vec_id, count_if(z > 0)::BIGINT AS kept, round(sum(z), 6) AS total FROM o GROUP BY ALL""",
    "prior_filter": f"""
        WITH {_PIX}, j AS (SELECT a.vec_id, a.z, b.z AS prior, a.u <> 7 AS ok FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.v = b.v AND a.u = b.u),
        m AS (SELECT vec_id, coalesce(median(prior) FILTER (z > 0 AND prior > 0 AND ok) / (median(z) FILTER (z > 0 AND prior > 0 AND ok) + 1e-6), 1) AS s FROM j GROUP BY ALL),
        o AS (SELECT vec_id, CASE WHEN abs(z*s - CASE WHEN z > 0 AND prior > 0 AND ok THEN prior ELSE 0 END) / (z*s + 1e-6) > 0.2 THEN 0 ELSE z END AS z FROM j JOIN m USING (vec_id))
        SELECT vec_id, count_if(z > 0)::BIGINT AS kept, round(sum(z), 6) AS total FROM o GROUP BY ALL""",
    "gradient_cut": f"""
        WITH {_PIX}, {_F32}, {_KERNEL},
        g AS (SELECT c.vec_id, c.v, c.u, c.z, sum(n.z * a.s * b.d) AS gx, sum(n.z * a.d * b.s) AS gy FROM f c, w a, w b, f n
              WHERE n.vec_id = c.vec_id AND n.v = {_mirror('c.v + a.o')} AND n.u = {_mirror('c.u + b.o')} GROUP BY ALL),
        out AS (SELECT vec_id, CASE WHEN sqrt(gx*gx + gy*gy) > 30 THEN 0 ELSE z END AS z FROM g) {_KEPT}""",
    "median_cut": f"""
        WITH {_PIX}, {_F32}, o AS (SELECT i - 3 AS o FROM range(7) t(i)),
        g AS (SELECT c.vec_id, c.v, c.u, c.z, median(n.z) AS m FROM f c, o a, o b, f n
              WHERE n.vec_id = c.vec_id AND n.v = {_mirror_edge('c.v + a.o')} AND n.u = {_mirror_edge('c.u + b.o')} GROUP BY ALL),
        out AS (SELECT vec_id, CASE WHEN greatest(abs(z / (m + 1e-8)), abs(m / (z + 1e-8))) > 5 THEN 0 ELSE z END AS z FROM g) {_KEPT}""",
    "depth_edge_mask": f"""
        WITH {_PIX}, {_F32}, g AS (SELECT c.vec_id, c.v, c.u, c.z, max(n.z) - min(n.z) AS r FROM f c JOIN f n
              ON n.vec_id = c.vec_id AND abs(n.v - c.v) <= 1 AND abs(n.u - c.u) <= 1 GROUP BY ALL),
        out AS (SELECT vec_id, CASE WHEN z > 0 AND r / z > 0.5 THEN z ELSE 0 END AS z FROM g) {_KEPT}""",
    "depth_errors": f"""
        WITH {_DEPTHS}, r AS (SELECT *, greatest(greatest(pred, 1e-5) / gt, gt / greatest(pred, 1e-5)) AS q, ln(greatest(pred, 1e-5)) - ln(gt) AS l FROM d WHERE gt > 0)
        SELECT seq, round(avg(abs(pred - gt) / gt), 6) AS abs_rel, round(avg((pred - gt)*(pred - gt) / gt), 6) AS sq_rel, round(sqrt(avg((pred - gt)*(pred - gt))), 6) AS rmse,
            round(sqrt(avg(l*l)), 6) AS log_rmse, round(avg((q < 1)::INT), 6) AS d0, round(avg((q < 1.25)::INT), 6) AS d1, round(avg((q < 1.5625)::INT), 6) AS d2,
            round(avg((q < 1.953125)::INT), 6) AS d3, count(*) AS valid FROM r GROUP BY seq""",
    "depth_scales": f"""
        WITH {_DEPTHS} SELECT seq, round(quantile_disc(gt, 0.5) / quantile_disc(pred, 0.5), 6) AS s_median, round(regr_slope(gt, pred), 6) AS s_lstsq, round(regr_intercept(gt, pred), 4) AS t_lstsq
        FROM d WHERE gt > 0 GROUP BY seq""",
    "depth_scale_irls": f"WITH {_DEPTHS}, s0 AS (SELECT seq, avg(gt) / avg(pred) AS s FROM d GROUP BY seq)" + "".join(
        f", s{i} AS (SELECT seq, sum(pred*gt / (abs(s*pred - gt) + 1e-8)) / sum(pred*pred / (abs(s*pred - gt) + 1e-8)) AS s FROM d JOIN s{i - 1} USING (seq) GROUP BY seq)" for i in (1, 2, 3)
    ) + " SELECT seq, round(greatest(s, 1e-3), 6) AS s FROM s3",
    "depth_scale_lad": f"""
        WITH {_DEPTHS}, f AS (SELECT seq, regr_slope(gt, pred) AS s, regr_intercept(gt, pred) AS t FROM d WHERE gt > 0 GROUP BY seq),
        w AS (SELECT seq, pred, gt, 1 / (abs(s*pred + t - gt) + 1e-8) AS w FROM d JOIN f USING (seq) WHERE gt > 0),
        m AS (SELECT seq, sum(w) AS w, sum(w*pred) AS x, sum(w*gt) AS y, sum(w*pred*pred) AS xx, sum(w*pred*gt) AS xy FROM w GROUP BY seq),
        r AS (SELECT *, (w*xy - x*y) / (w*xx - x*x) AS s FROM m)
        SELECT seq, round(s, 6) AS s, round((y - s*x) / w, 3) AS t FROM r""",
    "confidence_weights": f"""
        WITH {_WALK}, q AS (SELECT seq, quantile_cont(value, 0.8) AS h, quantile_cont(value, 0.1) AS l FROM e GROUP BY seq)
        SELECT seq, event_id, round(greatest(0, least(1, (value - l) / (h - l + 1e-3))), 6) AS weight FROM e JOIN q USING (seq)""",
    "first_visible": f"""
        WITH {_WALK}, u AS (SELECT DISTINCT seq FROM e),
        r AS (SELECT seq, event_id FROM e WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY us, event_id) = 1)
        SELECT seq, event_id FROM u LEFT JOIN r USING (seq)""",
    "lab_colors": f"""
        WITH p AS (SELECT DISTINCT scene, recon, point3d_id, rgb FROM point3d),
        n AS (SELECT scene, recon, point3d_id, rgb[1] AS red, rgb[2] AS green, rgb[3] AS blue,
            list_transform(rgb, lambda c: CASE WHEN c / 255.0::DOUBLE > 0.04045 THEN pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE c / 255.0::DOUBLE / 12.92 END) AS i FROM p),
        x AS (SELECT *, [(0.412453*i[1] + 0.357580*i[2] + 0.180423*i[3]) / 0.950456, 0.212671*i[1] + 0.715160*i[2] + 0.072169*i[3], (0.019334*i[1] + 0.119193*i[2] + 0.950227*i[3]) / 1.088754] AS t FROM n),
        f AS (SELECT *, list_transform(t, lambda v: CASE WHEN v > 0.008856 THEN cbrt(v) ELSE 7.787*v + 16/116.0::DOUBLE END) AS f FROM x)
        SELECT scene, recon, point3d_id, round(116*f[2] - 16, 5) AS l, round(500*(f[1] - f[2]), 5) AS a, round(200*(f[2] - f[3]), 5) AS b, red::INT AS red, green::INT AS green, blue::INT AS blue FROM f""",
    "aligned_depth_errors": f"""
        WITH {_DEPTHS}, f AS (SELECT seq, regr_slope(gt, pred) AS s, regr_intercept(gt, pred) AS t FROM d WHERE gt > 0 GROUP BY seq),
        a AS (SELECT seq, gt, greatest(s*pred + t, 1e-5) AS pred FROM d JOIN f USING (seq) WHERE gt > 0)
        SELECT seq, round(avg(abs(pred - gt) / gt), 6) AS abs_rel, round(sqrt(avg((pred - gt)*(pred - gt))), 4) AS rmse, round(avg((greatest(pred/gt, gt/pred) < 1.25)::INT), 6) AS d1, count(*) AS valid FROM a GROUP BY seq""",
    "nearest_points": f"WITH {_NN} SELECT scene, recon, idx, nn, round(distance, 6) AS distance FROM f",
    "cloud_accuracy": f"""
        WITH {_NN}, a AS (SELECT scene, recon, avg(distance) AS acc, median(distance) AS acc_median FROM f GROUP BY ALL),
        c AS (SELECT scene, recon, avg(distance) AS comp, median(distance) AS comp_median, avg((distance < 0.05)::INT) AS comp_ratio FROM b GROUP BY ALL)
        SELECT scene, recon, round(acc, 6) AS acc, round(acc_median, 6) AS acc_median, round(comp, 6) AS comp, round(comp_median, 6) AS comp_median, round(comp_ratio, 6) AS comp_ratio FROM a JOIN c USING (scene, recon)""",
    "mutual_points": f"WITH {_NN} SELECT f.scene, f.recon, f.idx AS a, f.nn AS b, round(f.distance, 6) AS distance FROM f JOIN b ON (b.scene, b.recon, b.idx, b.nn) = (f.scene, f.recon, f.nn, f.idx) WHERE f.distance <= 0.5",
    "voxel_iou": f"""
        WITH {_CLOUD}, v AS (SELECT scene, recon, floor(x) AS i, floor(y) AS j, floor(z) AS k, 1 AS s FROM gt UNION SELECT scene, recon, floor(x), floor(y), floor(z), 2 FROM pr),
        c AS (SELECT scene, recon, i, j, k, sum(s) AS s FROM v GROUP BY ALL)
        SELECT scene, recon, count_if(s = 3)::BIGINT AS n_common, count(*) AS n_union, round(count_if(s = 3) / count(*), 6) AS iou FROM c GROUP BY ALL""",
    "similarity_moments": f"""
        WITH {_CLOUD}, p AS (SELECT pr.scene, pr.recon, pr.x, pr.y, pr.z, gt.x AS u, gt.y AS v, gt.z AS w FROM pr JOIN gt USING (scene, recon, idx))
        SELECT scene, recon, count(*)::DOUBLE AS n, {', '.join(f'round(sum({c}), 6) AS s_{c}' for c in 'xyzuvw')},
        {', '.join(f'round(sum({a}*{b}), 6) AS s_{a}{b}' for a in 'uvw' for b in 'xyz')}, round(sum(x*x + y*y + z*z), 6) AS s_xx FROM p GROUP BY ALL""",
    # The rotation is the unit quaternion of the greatest eigenvalue of a symmetric 4x4 matrix of the moments, here by squaring the matrix.
    "similarity_fit": f"""
        WITH RECURSIVE {_CLOUD},
        p0 AS (SELECT pr.scene, pr.recon, pr.x, pr.y, pr.z, {", ".join(f"{r[0]!r}*gt.x + {r[1]!r}*gt.y + {r[2]!r}*gt.z AS {n}" for n, r in zip("uvw", _TURN))} FROM pr JOIN gt USING (scene, recon, idx)),
        c AS (SELECT scene, recon, {", ".join(f"avg({a}) AS m{a}" for a in "xyzuvw")} FROM p0 GROUP BY ALL HAVING count(*) >= 10),
        p AS (SELECT scene, recon, {", ".join(f"{a} - m{a} AS {a}" for a in "xyzuvw")} FROM p0 JOIN c USING (scene, recon)),
        k AS (SELECT scene, recon, {", ".join(f"avg({a}*{b}) AS {a}{b}" for a in "xyz" for b in "uvw")}, avg(x*x + y*y + z*z) AS xx FROM p GROUP BY ALL),
        n AS (SELECT scene, recon, [[xu+yv+zw, yw-zv, zu-xw, xv-yu], [yw-zv, xu-yv-zw, xv+yu, zu+xw], [zu-xw, xv+yu, -xu+yv-zw, yw+zv], [xv-yu, zu+xw, yw+zv, -xu-yv+zw]] AS a,
              2 * (abs(xu)+abs(yv)+abs(zw)+abs(xv)+abs(xw)+abs(yu)+abs(yw)+abs(zu)+abs(zv)) AS b FROM k),
        q AS (SELECT scene, recon, 0 AS i, list_transform(a, lambda r, i: list_transform(r, lambda v, j: (v + CASE WHEN i = j THEN b ELSE 0 END) / b)) AS a FROM n
              UNION ALL
              SELECT scene, recon, i + 1, list_transform(s, lambda r: list_transform(r, lambda v: v / (s[1][1] + s[2][2] + s[3][3] + s[4][4]))) FROM (
                  SELECT scene, recon, i, list_transform(a, lambda r: list_transform(a, lambda t: list_inner_product(r, t))) AS s FROM q WHERE i < 40)),
        v AS (SELECT scene, recon, list_sort(list_transform(a, lambda r: [list_inner_product(r, r), r[1], r[2], r[3], r[4]]), 'DESC')[1] AS r FROM q WHERE i = 40),
        u AS (SELECT scene, recon, r[2]/sqrt(r[1]) AS w, r[3]/sqrt(r[1]) AS i, r[4]/sqrt(r[1]) AS j, r[5]/sqrt(r[1]) AS h FROM v),
        m AS (SELECT scene, recon, [1-2*(j*j+h*h), 2*(i*j-w*h), 2*(i*h+w*j), 2*(i*j+w*h), 1-2*(i*i+h*h), 2*(j*h-w*i), 2*(i*h-w*j), 2*(j*h+w*i), 1-2*(i*i+j*j)] AS r FROM u)
        SELECT scene, recon, round((r[1]*xu + r[2]*yu + r[3]*zu + r[4]*xv + r[5]*yv + r[6]*zv + r[7]*xw + r[8]*yw + r[9]*zw) / xx, 4) AS s, {", ".join(f"round(r[{i + 1}], 4) AS r{i}" for i in range(9))}
        FROM m JOIN k USING (scene, recon)""",
    "asof_events": f"""
        WITH {_WALK}, k AS (SELECT list_sort(list(DISTINCT event_type)) AS k FROM e WHERE event_type IS NOT NULL),
        j AS (SELECT a.seq, a.event_id, min(abs(a.us - b.us)) AS gap FROM e a JOIN e b USING (seq), k WHERE a.event_type = k[1] AND b.event_type = k[2] GROUP BY ALL)
        SELECT seq, event_id, gap / 1e6 AS gap_s FROM j WHERE gap <= 3.6e9 * 24""",
    "lagged_motion": f"""
        WITH {_WALK}, d AS (SELECT seq, value - lag(value) OVER (PARTITION BY seq ORDER BY us, event_id) AS d FROM e)
        SELECT seq, round(sqrt(avg(d*d)), 6) AS rpe FROM d GROUP BY seq""",
    "strided_events": f"""
        WITH {_WALK}, n AS (SELECT seq, event_id, row_number() OVER (PARTITION BY seq ORDER BY us, event_id) - 2 AS k FROM e)
        SELECT seq, event_id FROM n WHERE k >= 0 AND k % 3 = 0 AND k < 15""",
    "last_event": f"WITH {_WALK} SELECT seq, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY seq ORDER BY us DESC, event_id DESC) = 1",
    "macro_and_micro": f"WITH {_WALK}, m AS (SELECT seq, avg(value) AS v FROM e GROUP BY seq) SELECT (SELECT round(avg(value), 6) FROM e) AS micro, round(avg(v), 6) AS macro FROM m",
    "whole_samples": "SELECT sample_uid, max(len(map_keys(imgs)))::BIGINT AS images, max(len(edges))::BIGINT AS edges FROM sampled_case WHERE len(map_keys(imgs)) >= 24 GROUP BY sample_uid",
    "sample_neighbours": """
        WITH n AS (SELECT DISTINCT sample_uid, unnest(map_keys(imgs)) AS id FROM sampled_case WHERE imgs IS NOT NULL),
        u AS (SELECT sample_uid, unnest(edges) AS u FROM sampled_case WHERE imgs IS NOT NULL),
        l AS (SELECT sample_uid, u.src AS p, u.dst AS q FROM u UNION SELECT sample_uid, u.dst, u.src FROM u)
        SELECT x.sample_uid, count_if(x.id = y.id OR l.p IS NOT NULL)::BIGINT AS linked, count(*) AS pairs
        FROM n x JOIN n y USING (sample_uid) LEFT JOIN l ON l.sample_uid = x.sample_uid AND l.p = x.id AND l.q = y.id GROUP BY ALL""",
    "listed_samples": "SELECT DISTINCT scene_recon_name, sample_uid FROM sampled_case WHERE scene_recon_name IN (SELECT scene_recon_name FROM recon_split)",
    "track_lengths": """
        WITH a AS (SELECT scene, recon, avg(n) AS mean_observations FROM (SELECT DISTINCT scene, recon, image_id, len(point3d_ids) AS n FROM image) GROUP BY ALL),
        b AS (SELECT scene, recon, avg(n) AS mean_track FROM (SELECT DISTINCT scene, recon, point3d_id, len(image_ids) AS n FROM point3d) GROUP BY ALL)
        SELECT scene, recon, round(mean_observations, 6) AS mean_observations, round(mean_track, 6) AS mean_track FROM a JOIN b USING (scene, recon)""",
}
