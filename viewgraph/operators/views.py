"""Views (a raster with its image, intrinsics and pose) turned, cropped, resized and padded.

A view has h, w, k (9 doubles), and any of data (float32 depth), image (bytes, three channels) and w2c (12 or 16 doubles);
other columns go along. Boxes, sizes, intrinsics and poses are column expressions; only pixels go through NumPy, in Arrow
batches, one narrow pass a step. A view whose pixels don't fit its size has null pixels, and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import raster


def _mapped(views: DataFrame, kernel: Callable[..., np.ndarray], image_kernel: Callable[..., np.ndarray], *args: Column) -> dict[str, Column]:
    """New pixel columns: kernel(raster, *args) of those that are there."""

    def udf(f: Callable[..., np.ndarray], dtype: str, channels: int):
        def run(h: pd.Series, w: pd.Series, data: pd.Series, more: pd.DataFrame) -> pd.Series:
            out = []
            for i, values in enumerate(more.itertuples(index=False)):
                try:
                    shape = (int(h.iloc[i]), int(w.iloc[i])) + ((channels,) if channels > 1 else ())
                    z = np.frombuffer(data.iloc[i], dtype).reshape(shape)
                    out.append(np.ascontiguousarray(f(z, *map(int, values)), dtype).tobytes())
                except (TypeError, ValueError):
                    out.append(None)
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, "binary")

    more = F.struct(*[a.cast("int").alias(f"a{i}") for i, a in enumerate(args)])
    out = {}
    for name, f, dtype, channels in (("data", kernel, "<f4", 1), ("image", image_kernel, "u1", 3)):
        if name in views.columns:
            out[name] = udf(f, dtype, channels)("h", "w", name, more)
    return out


def upright(views: DataFrame, orientation: Column, back: bool = False) -> DataFrame:
    """Views with their EXIF orientation (1 to 8) undone, or put back. Intrinsics turn as the pixels do; an unknown orientation turns nothing."""
    o = F.when(orientation.between(1, 8), orientation).otherwise(1)
    undone = o if not back else F.when(o == 6, 8).when(o == 8, 6).otherwise(o)
    f = lambda z, n: raster.upright(z, n) if z.ndim == 2 else np.stack([raster.upright(z[..., c], n) for c in range(z.shape[2])], -1)
    turned = undone >= 5
    new = {"h": F.when(turned, F.col("w")).otherwise(F.col("h")), "w": F.when(turned, F.col("h")).otherwise(F.col("w"))}
    return views.withColumns(_mapped(views, f, f, undone) | new | {"k": g.oriented_intrinsics(F.col("k"), F.col("w"), F.col("h"), undone)})


def cropped(views: DataFrame, height: Column, width: Column, strict: bool = False) -> DataFrame:
    """Views cut about their principal point to at most height x width: as much as lies on both sides of it, or, if strict,
    exactly so much, with zeros where the raster ends. A view smaller than that, or whose principal point lies outside, is cut to nothing: null pixels."""
    cx, cy = g.at(F.col("k"), 2), g.at(F.col("k"), 5)
    half = lambda size, c, n: F.floor(F.least(size / 2, c) if strict else F.least(size / 2, c, n - c))
    up, aside = half(height, cy, F.col("h")), half(width, cx, F.col("w"))
    top, left = F.floor(cy) - up, F.floor(cx) - aside
    h, w = (height, width) if strict else (2 * up, 2 * aside)
    fits = (F.col("h") >= height) & (F.col("w") >= width) & cx.between(0, F.col("w")) & cy.between(0, F.col("h"))
    f = lambda z, a, b, c, d: raster.crop(z, a, b, c, d, strict)
    pixels = {n: F.when(fits, c) for n, c in _mapped(views, f, f, top, left, h, w).items()}
    return views.withColumns(pixels | {"h": h.cast("int"), "w": w.cast("int"), "k": g.cropped_intrinsics(F.col("k"), left.cast("double"), top.cast("double"))})


def resized(views: DataFrame, height: Column, width: Column, safe: float = 4.0) -> DataFrame:
    """Views resized, in one scale, so that they cover height x width and `safe` pixels; depth by nearest pixels, images smoothly."""
    scale = g.resize_scale(F.col("w"), F.col("h"), width, height, safe)
    h, w = F.floor(F.col("h") * scale).cast("int"), F.floor(F.col("w") * scale).cast("int")
    real = F.greatest(h / F.col("h"), w / F.col("w"))
    return views.withColumns(_mapped(views, raster.resize_nearest, raster.resize_smooth, h, w) | {"h": h, "w": w, "k": g.resized_intrinsics(F.col("k"), real)})


def turned(views: DataFrame, clockwise: Column) -> DataFrame:
    """Views turned by a quarter, with their intrinsics and pose."""
    f = lambda z, c: np.rot90(z, -1 if c else 1)
    new = {"h": F.col("w"), "w": F.col("h"), "k": g.quarter_turn_intrinsics(F.col("k"), F.col("w").cast("double"), F.col("h").cast("double"), clockwise)}
    if "w2c" in views.columns:
        new["w2c"] = g.quarter_turn_extrinsics(F.col("w2c"), clockwise)
    return views.withColumns(_mapped(views, f, f, clockwise) | new)


def padded(views: DataFrame) -> DataFrame:
    """Views in the middle of a square: depth 0 and white around them."""
    side = F.greatest("h", "w")
    top, left = F.floor((side - F.col("h")) / 2), F.floor((side - F.col("w")) / 2)
    pixels = _mapped(views, lambda z, _: raster.square_pad(z)[0], lambda z, _: raster.square_pad(z, 255)[0], F.lit(0))
    return views.withColumns(pixels | {"h": side, "w": side, "k": g.padded_intrinsics(F.col("k"), left.cast("double"), top.cast("double"))})


def prepared(views: DataFrame, height: int, width: int, safe: float = 4.0, orientation: Column | None = None) -> DataFrame:
    """Views as a loader hands them out: upright, cut about the principal point so that it lies in the middle, resized to cover
    height x width, and cut to exactly that."""
    if orientation is not None:
        views = upright(views, orientation)
    views = cropped(views, F.col("h"), F.col("w"))
    views = resized(views, F.lit(height), F.lit(width), safe)
    return cropped(views, F.lit(height), F.lit(width), strict=True)
