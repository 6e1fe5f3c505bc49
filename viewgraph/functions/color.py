"""Colours as Column expressions: Lab and back, transfer of means and deviations, and colours by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear RGB to XYZ and the white point (D65).
_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)
_TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of bytes of sRGB."""
    lin = [F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92) for c in (r, g, b)]
    f = []
    for row, white in zip(_TO_XYZ, _WHITE):
        t = (lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116))
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """Bytes of sRGB, clipped."""
    fy = (l + 16) / 116
    xyz = []
    for f, white in zip((fy + a / 500, fy, fy - b / 200), _WHITE):
        xyz.append(F.when(f > 0.206893, f * f * f).otherwise((f - 16 / 116) / 7.787) * white)
    out = []
    for row in _TO_RGB:
        c = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        c = F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), F.round(c * 255))).cast("int"))
    return out


def matched_colors(pixels: DataFrame, sequence: list[str], image: str) -> DataFrame:
    """pixels (sequence, image, l, a, b, ok) with each image's Lab means and deviations over its ok pixels
    moved to the means of those of all images of its sequence. Images without ok pixels stay."""
    stat = lambda f, n: [f(F.when(F.col("ok"), F.col(c))).alias(f"__{n}_{c}") for c in "lab"]
    per = pixels.groupBy(*sequence, image).agg(*stat(F.avg, "m"), *stat(F.stddev_pop, "s"))
    whole = per.groupBy(*sequence).agg(*[F.avg(f"__{n}_{c}").alias(f"__t{n}_{c}") for n in "ms" for c in "lab"])
    rows = pixels.join(per, [*sequence, image]).join(whole, sequence)
    new = {c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6) * F.col(f"__ts_{c}") + F.col(f"__tm_{c}"), F.col(c)) for c in "lab"}
    return rows.withColumns(new).select(*pixels.columns)


def color_by_place(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """Bytes of a colour whose hue is the direction from the middle and whose strength is the distance from it."""
    u, v = x / width * 2 - 1, y / height * 2 - 1
    hue, strength = (F.atan2(v, u) / 3.141592653589793 + 1) * 3, F.least(F.sqrt(u * u + v * v), F.lit(1.0))
    out = []
    for shift in (0, 4, 2):
        k = F.pmod(hue + shift, F.lit(6.0))
        ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(k - 3) - 1))
        out.append(F.round(255 * (1 - strength * (1 - ramp))).cast("int"))
    return out
