"""Filters of images, samples and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PANORAMA_ASPECT = 3.0
MIN_COVERAGE = 0.02


def fisheye(lens: Column, focal: Column, focal35: Column) -> Column:
    """Whether a lens name, focal length or 35 mm equivalent speaks of a fisheye; unknown values don't.
    Focal lengths must be whole numbers to count, given as integer columns."""
    by_name = F.contains(F.lower(lens), F.lit("fisheye"))
    by_focal = (focal > 0) & (focal <= 2.5) & (focal != 1.1)
    by_35 = (focal35 > 0) & (focal35 <= 10) & ~focal35.isin(0, 3, 4, 5)
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_focal, F.lit(False)) | F.coalesce(by_35, F.lit(False))


def panorama(name: Column, width: Column, height: Column) -> Column:
    """Whether the aspect or the file's name speaks of a panorama."""
    base = F.lower(F.substring_index(name, "/", -1))
    aspect = F.greatest(width, height) / F.least(width, height) >= PANORAMA_ASPECT
    named = F.contains(base, F.lit("pano")) & ~F.contains(base, F.lit("panoramio"))
    return F.coalesce(aspect, F.lit(False)) | F.coalesce(named, F.lit(False))


def keep_image(readable: Column, has_exif: Column, is_fisheye: Column, is_panorama: Column) -> Column:
    """Unreadable images go, those without metadata stay whatever they show, then fisheyes and panoramas go."""
    return F.when(~readable, False).when(~has_exif, True).otherwise(~is_fisheye & ~is_panorama)


def coverage(pixels: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """keys, coverage: the share of pixels with depth over 0."""
    return pixels.groupBy(*keys).agg(F.avg((F.col(z) > 0).cast("double")).alias("coverage"))


def covered(images: DataFrame, shares: DataFrame, keys: list[str], least: float = MIN_COVERAGE) -> DataFrame:
    """Images with a depth map of which at least the given share is valid; those without one go."""
    return images.join(shares.where(F.col("coverage") >= least).select(*keys), keys, "left_semi")


def percentile_cut(pixels: DataFrame, keys: list[str], z: str = "z", share: float = 0.98) -> DataFrame:
    """pixels with depths above the percentile (over all pixels, zeros too) set to 0; a threshold of 0 cuts nothing."""
    cut = pixels.groupBy(*keys).agg(F.percentile(z, F.lit(share)).alias("__cut"))
    return pixels.join(cut, keys).withColumn(z, F.when((F.col("__cut") > 0) & (F.col(z) > F.col("__cut")), 0.0).otherwise(F.col(z))).drop("__cut")


def prior_scaled_error(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """pixels (z, prior, ok) with error: |s z - prior| / (s z + 1e-6), where s takes the median depth to that of the
    prior over pixels valid in both, and the prior counts as 0 elsewhere."""
    valid = (F.col("z") > 0) & (F.col("prior") > 0) & F.col("ok")
    med = lambda c: F.percentile(F.when(valid, F.col(c)), F.lit(0.5))
    scale = pixels.groupBy(*keys).agg(F.coalesce(med("prior") / (med("z") + 1e-6), F.lit(1.0)).alias("__s"))
    z, prior = F.col("z") * F.col("__s"), F.when(valid, F.col("prior")).otherwise(0.0)
    return pixels.join(scale, keys).withColumn("error", F.abs(z - prior) / (z + 1e-6)).drop("__s")


def prior_filter(pixels: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    out = prior_scaled_error(pixels, keys)
    return out.withColumn("z", F.when(F.col("error") > threshold, 0.0).otherwise(F.col("z"))).drop("error")


def min_images(samples: DataFrame, n: int) -> DataFrame:
    """Samples of at least n images; null ones go."""
    return samples.where(F.size(F.map_keys("imgs")) >= n)


def recon_ids(selector: str | None) -> list[str] | None:
    """The reconstructions that a selector names; None for all (all, auto, * or nothing)."""
    text = (selector or "").strip()
    if text.lower() in ("", "all", "auto", "*"):
        return None
    return [x.strip() for x in text.split(",") if x.strip()]


def stride(df: DataFrame, keys: list[str], order: str, skip: int = 0, step: int = 1, n: int | None = None) -> DataFrame:
    """Every step-th row of a sequence from skip on, n at most."""
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1 - skip
    out = df.withColumn("__at", at).where((F.col("__at") >= 0) & (F.col("__at") % step == 0))
    if n is not None:
        out = out.where(F.col("__at") < n * step)
    return out.drop("__at")


def last_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each group, such as a file's."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose output doesn't exist yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def image_path(depth_path: Column, images_dir: str, suffix: str = ".geometric.bin") -> Column:
    """The image of a depth file below the images' folder."""
    return F.concat(F.lit(images_dir.rstrip("/") + "/"), F.regexp_replace(depth_path, suffix.replace(".", r"\.") + "$", ""))
