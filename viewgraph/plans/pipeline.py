"""The whole runs: scene sampling, depth cleaning, and the evaluations, as functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import raster
from ..operators import filters
from ..operators import graph as gr
from ..operators import metrics as mt
from ..operators import nearest as nn
from ..operators import registration as reg
from ..operators import samplers
from ..scale import Workspace

KEYS = ["scene", "recon"]


@dataclass(frozen=True)
class SamplingOptions:
    """What a sampling run can be told; matches None takes the graph from co-observation alone."""

    images_per_sample: int = 24
    cases: int | None = 64
    min_matches: int = gr.MIN_MATCHES
    min_common: int = gr.MIN_COMMON_POINTS
    seed: int = 42
    trials: int = 512
    top_k: int = 32


def image_graph(matches: DataFrame | None, observed: DataFrame, images: DataFrame, options: SamplingOptions = SamplingOptions()) -> DataFrame:  # noqa: B008
    """keys, src, dst (names), weight: by matches where there are any, else by common points; images (keys, image_id, name)."""
    names = images.select(*KEYS, "image_id", gr.flat_name(F.col("name")).alias("name")).dropDuplicates([*KEYS, "image_id"])
    if matches is not None:
        edges = gr.build_graph(matches.withColumns({c: gr.flat_name(F.col(c)) for c in ("src", "dst")}), ["loaded_at"], KEYS, least=options.min_matches)
        return gr.induced(edges, names.select(*KEYS, F.col("name").alias("id")), KEYS)
    seen = gr.co_observation(observed, KEYS, "image_id", "point3d_id", options.min_common)
    a, b = names.select(*KEYS, F.col("image_id").alias("src"), F.col("name").alias("a")), names.select(*KEYS, F.col("image_id").alias("dst"), F.col("name").alias("b"))
    both = seen.join(a, [*KEYS, "src"]).join(b, [*KEYS, "dst"])
    return both.select(*KEYS, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("common_pts").alias("weight"))


def sample_scenes(edges: DataFrame, images: DataFrame, cameras: DataFrame, observed: DataFrame, kept: DataFrame | None = None, options: SamplingOptions = SamplingOptions()) -> DataFrame:  # noqa: B008
    """keys, case, imgs, edges: samples of connected images with poses and intrinsics. edges: the image graph by names.
    kept (keys, id) are the names that pass the image and depth filters; None keeps all."""
    if kept is not None:
        edges = gr.induced(edges, kept, KEYS)
    names = images.select(*KEYS, "image_id", "camera_id", gr.flat_name(F.col("name")).alias("id"), "qvec", "tvec").dropDuplicates([*KEYS, "id"])
    posed = names.withColumn("w2c", g.rigid(g.quat_wxyz_to_matrix(F.col("qvec")), F.col("tvec")))
    centers = posed.select(*KEYS, "id", g.camera_center(F.col("w2c")).alias("center"))
    big = gr.large_enough(edges, KEYS, options.images_per_sample, options.images_per_sample - 1)
    edges = edges.join(big.select(*KEYS), KEYS, "left_semi")
    ids = posed.select(*KEYS, "id", "image_id")
    wanted = edges.join(ids.toDF(*KEYS, "src", "ia"), [*KEYS, "src"]).join(ids.toDF(*KEYS, "dst", "ib"), [*KEYS, "dst"])
    pairs = wanted.select(*KEYS, "src", "dst", "weight", F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib"))
    common = gr.co_observation(observed, KEYS, "image_id", "point3d_id", options.min_common, pairs.select(*KEYS, F.col("ia").alias("src"), F.col("ib").alias("dst")))
    attributed = pairs.join(common.toDF(*KEYS, "ia", "ib", "common_pts"), [*KEYS, "ia", "ib"])
    attributed = gr.edge_distance(attributed, centers, gr.mean_scale(centers, F.col("center"), KEYS), KEYS).select(*KEYS, "src", "dst", "weight", "common_pts", "distance")
    picked = samplers.scene_samples(attributed, KEYS, options.images_per_sample, options.cases, options.seed, "common_pts", options.trials, options.top_k)
    k = g.intrinsics(F.col("model"), F.col("params"))
    rows3 = lambda m, w: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda r: F.slice(m, r * w + 1, F.lit(w)))
    view = F.struct(rows3(g.rigid_inverse(F.col("w2c")), 4).alias("c2w"), rows3(k, 3).alias("k"), F.lit(None).cast("string").alias("depth_path"))
    cams = cameras.select(*KEYS, "camera_id", "model", "params").dropDuplicates([*KEYS, "camera_id"])
    views = posed.join(cams, [*KEYS, "camera_id"], "left").select(*KEYS, "id", view.alias("view"))
    imgs = picked.join(views, [*KEYS, "id"]).groupBy(*KEYS, "case").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "view")))).alias("imgs"))
    inside = attributed.join(picked.select(*KEYS, "case", F.col("id").alias("src")), [*KEYS, "src"]).join(picked.select(*KEYS, "case", F.col("id").alias("dst")), [*KEYS, "case", "dst"])
    links = inside.groupBy(*KEYS, "case").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    return imgs.join(links, [*KEYS, "case"], "left")


def clean_depths(depths: DataFrame, classes: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """path, h, w, data: depth rasters cleaned by their class maps (path, classes: int32), then by a prior (path, prior: float32,
    0 outside its mask). A raster that can't be processed comes out null and stops nothing."""
    udf = raster.raster_udf(lambda z, c: raster.clean(z.astype(float), c), True)
    out = depths.join(classes, "path", "left").select("path", "h", "w", udf("h", "w", "data", "classes").alias("data"))
    if priors is None:
        return out

    def against(z: np.ndarray, bits: np.ndarray) -> np.ndarray:
        prior = bits.view("float32")
        return raster.cut_by_prior(z.astype(float), prior.astype(float), prior > 0)

    prior_udf = raster.raster_udf(against, True)
    return out.join(priors, "path", "left").select("path", "h", "w", F.when(F.col("prior").isNotNull(), prior_udf("h", "w", "data", "prior")).otherwise(F.col("data")).alias("data"))


def evaluate_poses(poses: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(per sequence, over all pairs of a model and data set): keys name model, data set and sequence in this order."""
    pairs = Workspace(poses.sparkSession, "poses").write(mt.pose_pairs(poses, keys)).df
    return mt.pose_summary(pairs, keys), mt.pose_summary(pairs, keys[:-1], in_rounds=True)


def evaluate_clouds(gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float = 0.1, icp_rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """(per sequence, macro average): clouds (keys, idx, x, y, z) with common idx are aligned by Sim(3), then ICP, and compared."""
    pairs = pred.join(gt.toDF(*keys, "idx", "u", "v", "w"), [*keys, "idx"])
    aligned = reg.icp(reg.moved(pred, reg.similarity(pairs, keys), keys), gt, keys, threshold, icp_rounds)
    gn, pn = reg.normals(gt, keys), reg.normals(aligned, keys)

    def side(a: DataFrame, b: DataFrame, na: DataFrame, nb: DataFrame) -> DataFrame:
        near = nn.nearest(a, b, keys, threshold)
        with_a = near.join(na.toDF(*keys, "idx", "ax", "ay", "az"), [*keys, "idx"]).join(nb.toDF(*keys, "nn", "bx", "by", "bz"), [*keys, "nn"])
        return with_a.withColumn("normal_dot", F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz"))

    per = mt.reconstruction_summary(side(aligned, gt, pn, gn), side(gt, aligned, gn, pn), keys)
    return per, mt.macro_average(per, [c for c in per.columns if c not in keys], keys[:-1])


def passing_images(images: DataFrame, meta: DataFrame, shares: DataFrame) -> DataFrame:
    """keys, id of images that pass the image filter and have enough depth. meta: keys, id, width, height, lens, focal, focal35, has_exif."""
    ok = filters.keep_image(F.col("width").isNotNull(), F.coalesce("has_exif", F.lit(False)), filters.fisheye(F.col("lens"), F.col("focal"), F.col("focal35")), filters.panorama(F.col("id"), F.col("width"), F.col("height")))
    kept = images.select(*KEYS, "id").distinct().join(meta, [*KEYS, "id"]).where(ok)
    return filters.covered(kept, shares, [*KEYS, "id"]).select(*KEYS, "id")
