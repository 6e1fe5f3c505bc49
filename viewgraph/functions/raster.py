"""Kernels over dense rasters: NumPy in Arrow batches, one raster a row.

A raster is (h INT, w INT, data BINARY of float32, row by row); depth 0 is invalid. Borders:
gradients mirror without the edge pixel, medians mirror with it, erosion takes outside for empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

# Background classes of the segmentation, and its sky.
BACKGROUND = (0, 1, 3, 5, 6, 8, 9, 11, 13, 14, 16, 25, 26, 29, 40, 42, 46, 48, 51, 52, 53, 54, 59, 60, 61, 68, 84, 91, 94, 101, 113, 128)
SKY = 2

_SMOOTH = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
_SLOPE = np.array([-1.0, -2.0, 0.0, 2.0, 1.0])


def gradient(z: np.ndarray) -> np.ndarray:
    """Length of the 5x5 Sobel gradient."""
    p = np.pad(z.astype(float), 2, mode="reflect") if min(z.shape) > 2 else np.pad(z.astype(float), 2, mode="symmetric")
    v = sliding_window_view(p, (5, 5))
    return np.hypot(np.einsum("ijkl,k,l->ij", v, _SMOOTH, _SLOPE), np.einsum("ijkl,k,l->ij", v, _SLOPE, _SMOOTH))


def median(z: np.ndarray, size: int = 7) -> np.ndarray:
    p = np.pad(z, size // 2, mode="symmetric")
    return np.median(sliding_window_view(p, (size, size)).reshape(*z.shape, -1), axis=-1)


def erode(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=False)
    return sliding_window_view(p, (3, 3)).all(axis=(-2, -1))


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components, numbered from 1 in reading order."""
    h, w = mask.shape
    index = np.arange(h * w).reshape(h, w)
    pairs = [np.stack([index[:, :-1][m := mask[:, :-1] & mask[:, 1:]], index[:, 1:][m]]), np.stack([index[:-1][m := mask[:-1] & mask[1:]], index[1:][m]])]
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(h * w)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    out = np.zeros(h * w, int)
    at = np.flatnonzero(mask.ravel())
    ids, number = np.unique(root[at], return_inverse=True)
    out[at] = number + 1
    return out.reshape(h, w), len(ids)


def swap_photometric(z: np.ndarray, pho: np.ndarray, ratio: float = 1.1) -> np.ndarray:
    return np.where(z / (pho + 1e-6) > ratio, pho, z)


def cut_gradient(z: np.ndarray, most: float = 50.0) -> np.ndarray:
    return np.where(gradient(z) > most, 0, z)


def cut_unstable(z: np.ndarray, most: float = 1.15) -> np.ndarray:
    m = median(z)
    score = np.maximum(np.abs(z / (m + 1e-8)), np.abs(m / (z + 1e-8)))
    return np.where(score > most, 0, z)


def cut_sparse_objects(z: np.ndarray, classes: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Components of foreground classes with a smaller share of valid pixels go."""
    out = z.copy()
    for c in np.unique(classes):
        if c in BACKGROUND or c == SKY:
            continue
        labels, n = label(classes == c)
        flat = labels.ravel()
        size = np.bincount(flat, minlength=n + 1)
        valid = np.bincount(flat, weights=(out > 0).ravel(), minlength=n + 1)
        bad = valid < least * size
        bad[0] = False
        out[bad[labels]] = 0
    return out


def cut_sky(z: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.where(classes == SKY, 0, z)


def cut_small(z: np.ndarray, least: int = 50) -> np.ndarray:
    """What is left of an eroded mask in components of at least so many pixels; all outside the eroded mask goes."""
    core = erode(z > 0)
    labels, n = label(core)
    size = np.bincount(labels[core], minlength=n + 1)
    return np.where((size < least)[labels] | ~core, 0, z)


def clean(z: np.ndarray, classes: np.ndarray, pho: np.ndarray | None = None, least_pixels: int = 50) -> np.ndarray:
    """All of the above in order."""
    if pho is not None:
        z = swap_photometric(z, pho)
    return cut_small(cut_sky(cut_sparse_objects(cut_unstable(cut_gradient(z)), classes), classes), least_pixels)


def cut_by_prior(z: np.ndarray, prior: np.ndarray, ok: np.ndarray, by_gradient: bool = False, error: float = 0.2, slope: float = 0.2) -> np.ndarray:
    """Pixels off the scaled prior go, those outside its mask too."""
    valid = (z > 0) & (prior > 0) & ok
    scaled = z * (np.median(prior[valid]) / (np.median(z[valid]) + 1e-6)) if valid.any() else z
    prior = np.where(valid, prior, 0)
    out = np.where(np.abs(scaled - prior) / (scaled + 1e-6) > error, 0, z)
    if by_gradient:
        steep = np.abs(gradient(scaled) / np.maximum(scaled, 1e-3) - gradient(prior) / np.maximum(prior, 1e-3))
        out = np.where(steep > slope, 0, out)
    return out


def ordinal(z: np.ndarray, classes: np.ndarray, share: float = 0.05) -> np.ndarray:
    """2 for the far quarter of large background parts, 1 for the core of large objects, else 0."""
    out = np.zeros(z.shape, np.uint8)
    least = z.size * share
    ground = np.isin(classes, BACKGROUND) & (z > 0)
    if ground.any():
        labels, n = label(ground)
        big = np.bincount(labels.ravel(), minlength=n + 1) > least
        big[0] = False
        out[big[labels] & (z >= np.percentile(z[ground], 75))] = 2
    for c in np.unique(classes):
        if c in BACKGROUND or c == SKY:
            continue
        labels, n = label(classes == c)
        for i in np.flatnonzero(np.bincount(labels.ravel(), minlength=n + 1)[1:] >= least) + 1:
            out[erode(labels == i)] = 1
    return out


def depth_edges(z: np.ndarray, atol: float | None = None, rtol: float | None = None, size: int = 3) -> np.ndarray:
    """Where depth varies within a window by more than a tolerance, absolute or relative."""
    r = size // 2
    high = sliding_window_view(np.pad(z, r, constant_values=-np.inf), (size, size)).max((-2, -1))
    low = sliding_window_view(np.pad(z, r, constant_values=np.inf), (size, size)).min((-2, -1))
    out = np.zeros(z.shape, bool)
    if atol is not None:
        out |= high - low > atol
    if rtol is not None:
        with np.errstate(divide="ignore", invalid="ignore"):
            out |= (high - low) / z > rtol
    return out


def upright(z: np.ndarray, orientation: int, back: bool = False) -> np.ndarray:
    """A raster with its EXIF orientation undone, or put back."""
    steps: dict[int, list[Callable]] = {
        1: [], 2: [np.fliplr], 3: [lambda a: np.rot90(a, 2)], 4: [np.flipud], 5: [np.transpose], 6: [lambda a: np.rot90(a, -1)],
        7: [lambda a: np.rot90(a, 2).T], 8: [np.rot90],
    }
    inverse = {6: 8, 8: 6}
    o = inverse.get(orientation, orientation) if back else orientation
    for f in steps[o]:
        z = f(z)
    return np.ascontiguousarray(z)


def crop(z: np.ndarray, top: int, left: int, height: int, width: int, strict: bool = False) -> np.ndarray:
    """A window of a raster; strict fills what lies outside with 0."""
    part = z[max(0, top) : max(0, top + height), max(0, left) : max(0, left + width)]
    if not strict or part.shape[:2] == (height, width):
        return part
    out = np.zeros((height, width, *z.shape[2:]), z.dtype)
    y, x = max(0, -top), max(0, -left)
    out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def resize_nearest(z: np.ndarray, height: int, width: int) -> np.ndarray:
    y = np.minimum((np.arange(height) * (z.shape[0] / height)).astype(int), z.shape[0] - 1)
    x = np.minimum((np.arange(width) * (z.shape[1] / width)).astype(int), z.shape[1] - 1)
    return z[y][:, x]


def _weights(n_in: int, n_out: int, kernel: Callable, support: float) -> np.ndarray:
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    center = (np.arange(n_out) + 0.5) * scale
    w = kernel((np.arange(n_in)[None] + 0.5 - center[:, None]) / stretch)
    w[np.abs(np.arange(n_in)[None] + 0.5 - center[:, None]) > support * stretch] = 0
    return w / w.sum(1, keepdims=True)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0))


def resize_smooth(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos where an image shrinks, bicubic where it grows."""
    kernel, support = (_lanczos, 3.0) if height < image.shape[0] else (_cubic, 2.0)
    y, x = _weights(image.shape[0], height, kernel, support), _weights(image.shape[1], width, kernel, support)
    out = np.einsum("yi,ij...,xj->yx...", y, image.astype(float), x)
    return np.clip(np.rint(out), 0, 255).astype(image.dtype) if image.dtype == np.uint8 else out.astype(image.dtype)


def square_pad(z: np.ndarray, fill: float = 0) -> tuple[np.ndarray, int, int]:
    """(a square raster with z in its middle, left, top)."""
    h, w = z.shape[:2]
    side = max(h, w)
    top, left = (side - h) // 2, (side - w) // 2
    out = np.full((side, side, *z.shape[2:]), fill, z.dtype)
    out[top : top + h, left : left + w] = z
    return out, left, top


def decode(h: int, w: int, data: bytes, dtype: str = "float32") -> np.ndarray:
    return np.frombuffer(data, dtype=dtype).reshape(h, w)


def raster_udf(kernel: Callable[..., np.ndarray], classes: bool = False, dtype: str = "float32"):
    """A Pandas UDF (h, w, data[, classes as int32]) -> data. Rows with nulls or wrong sizes give null."""

    def run(h: pd.Series, w: pd.Series, data: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for i in range(len(h)):
            try:
                args = [decode(int(h.iloc[i]), int(w.iloc[i]), data.iloc[i])]
                args += [decode(int(h.iloc[i]), int(w.iloc[i]), m.iloc[i], "int32") for m in more]
                out.append(np.ascontiguousarray(kernel(*args), dtype=dtype).tobytes())
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    if classes:
        def with_classes(h: pd.Series, w: pd.Series, data: pd.Series, c: pd.Series) -> pd.Series:
            return run(h, w, data, c)

        return F.pandas_udf(with_classes, "binary")

    def alone(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return run(h, w, data)

    return F.pandas_udf(alone, "binary")
