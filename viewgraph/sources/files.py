"""Depth maps, trajectories, lists, metric files and point clouds."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import last_rows
from ..schema import RASTER
from .images import png_bytes, read_png
from .storage import write_files

SINTEL_TAG = 202021.25


def mvs_depth(data: bytes) -> np.ndarray:
    """`W&H&C&` and float32 in column order; one channel comes out as (H, W)."""
    end = -1
    for _ in range(3):
        end = data.index(b"&", end + 1)
    w, h, c = (int(x) for x in data[:end].split(b"&"))
    out = np.frombuffer(data, "<f4", w * h * c, end + 1).reshape((w, h, c), order="F").transpose(1, 0, 2)
    return out[:, :, 0] if c == 1 else out


def mvs_bytes(z: np.ndarray) -> bytes:
    h, w = z.shape
    return f"{w}&{h}&1&".encode() + z.astype("<f4").T.reshape(-1, order="F").tobytes()


def sintel_depth(data: bytes) -> np.ndarray:
    tag, w, h = struct.unpack_from("<fii", data)
    if tag != np.float32(SINTEL_TAG):
        raise ValueError("wrong tag")
    return np.frombuffer(data, "<f4", w * h, 12).reshape(h, w)


def sintel_camera(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(3x3 intrinsics, 3x4 extrinsics) after the tag."""
    if struct.unpack_from("<f", data)[0] != np.float32(SINTEL_TAG):
        raise ValueError("wrong tag")
    return np.frombuffer(data, "<f8", 9, 4).reshape(3, 3), np.frombuffer(data, "<f8", 12, 76).reshape(3, 4)


def sintel_bytes(z: np.ndarray) -> bytes:
    return struct.pack("<fii", SINTEL_TAG, z.shape[1], z.shape[0]) + z.astype("<f4").tobytes()


def npy_bytes(z: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, z)
    return out.getvalue()


def png_depth(scale: float) -> Callable[[bytes], np.ndarray]:
    """A reader of 16-bit PNG depths in parts of a unit; -1 where there is none."""

    def read(data: bytes) -> np.ndarray:
        z = read_png(data)
        return np.where(z == 0, -1, z / scale)

    return read


def npy_depth(data: bytes) -> np.ndarray:
    import io

    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    return loaded["depth"] if hasattr(loaded, "files") else loaded


def half_float(z: np.ndarray) -> np.ndarray:
    """16-bit integers that hold half floats; what is not finite is invalid."""
    out = z.astype(np.uint16).view(np.float16).astype(np.float32)
    return np.where(np.isfinite(out), out, 0)


def cleaned(z: np.ndarray, most: float = 1e9) -> np.ndarray:
    """Depths that are not finite or too large are invalid."""
    return np.where(np.isfinite(z) & (z <= most), z, 0).astype(np.float32)


def scaled_depth(value: Column, scale: float) -> Column:
    """An integer depth over its scale, with -1 where it is 0."""
    return F.when(value == 0, -1.0).otherwise(value / scale)


#: Readers by kind; what a data set adds to them is its scale and greatest depth.
READERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "mvs": mvs_depth, "sintel": sintel_depth, "npy": npy_depth, "half_png": lambda data: half_float(read_png(data)),
    "png_1000": png_depth(1000.0), "bonn": png_depth(5000.0), "kitti": png_depth(256.0),
}
#: Writers by kind, of depths of 0 and above.
DEPTH_WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "mvs": mvs_bytes, "sintel": sintel_bytes, "npy": npy_bytes, "half_png": lambda z: png_bytes(z.astype(np.float16).view(np.uint16)),
    "png_1000": lambda z: png_bytes(np.clip(np.rint(z * 1000), 0, 65535).astype(np.uint16)),
}
# Kind of reader or scale, and greatest depth, by data set.
DEPTH_SETS = {"sintel": ("sintel", 70.0), "bonn": ("bonn", 70.0), "kitti": ("kitti", None), "nyu": ("npy", None)}


def read_depths(spark: SparkSession, path: str, kind: str, glob: str | None = None) -> DataFrame:
    """path, h, w, data, error: all rasters below a folder. A file that can't be read is a row with its error, and stops nothing."""
    decode = READERS[kind]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = cleaned(decode(bytes(content)))
                    out.append((p, *z.shape, z.tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "h", "w", "data", "error"]).astype({"h": "Int32", "w": "Int32"})

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content").mapInPandas(rows, RASTER + ", error string")


def write_depths(rasters: DataFrame, kind: str) -> DataFrame:
    """Writes rasters (path, h, w, data) as one file each, lazily: path, bytes, error."""
    encode = DEPTH_WRITERS[kind]

    def content(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else encode(np.frombuffer(d, "<f4").reshape(int(a), int(b))) for a, b, d in zip(h, w, data)], dtype=object)

    return write_files(rasters.select("path", F.pandas_udf(content, "binary")("h", "w", "data").alias("content")), "path", "content")


def with_depth(images: DataFrame, depths: DataFrame, on: str) -> DataFrame:
    """Images with their raster; a zero raster of the image's size (h, w) where there is none."""
    zero = F.when(F.col("data").isNull(), F.unhex(F.repeat(F.lit("00000000"), F.col("h") * F.col("w")))).otherwise(F.col("data"))
    return images.join(depths.select(on, "data"), on, "left").withColumn("missing", F.col("data").isNull()).withColumn("data", zero)


def pixels(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, u, z: one row per pixel."""
    types = dict(rasters.dtypes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.data is None:
                    continue
                z = np.frombuffer(r.data, "<f4").reshape(int(r.h), int(r.w))
                v, u = np.indices(z.shape)
                yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, "v": v.ravel(), "u": u.ravel(), "z": z.ravel().astype(float)})

    return rasters.select(*keys, "h", "w", "data").mapInPandas(rows, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", v int, u int, z double")


# Lists and metrics


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """scene, recon, scene_recon_name of a JSON array of `scene>recon`."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("scene_recon_name"))
    return names.select(F.substring_index("scene_recon_name", ">", 1).alias("scene"), F.substring_index("scene_recon_name", ">", -1).alias("recon"), "scene_recon_name")


def sample_names(samples: Column, name: Column) -> Column:
    """`scene>recon>k` for the k-th of so many samples."""
    return F.when(samples > 0, F.transform(F.sequence(F.lit(0), samples - 1), lambda k: F.concat(name, F.lit(">"), k.cast("string"))))


def read_sequence_ids(spark: SparkSession, path: str) -> DataFrame:
    """seq, pos, id of a JSON object of lists."""
    maps = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("seq", "ids"))
    return maps.select("seq", F.posexplode("ids").alias("pos", "id"))


def gather_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each metric file of a folder, with its file. A folder without files is an error."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/*.csv")
    rows = rows.withColumn("file", F.substring_index(F.input_file_name(), "/", -1)).withColumn("__at", F.monotonically_increasing_id())
    return last_rows(rows, ["file"], "__at").drop("__at")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


# Patterns of a metric text.
METRIC = {"ate": r"(?i)\bATE:?\s*([0-9.eE+-]+)", "rpe_trans": r"(?i)\bRPE[ _]trans:?\s*([0-9.eE+-]+)", "rpe_rot": r"(?i)\bRPE[ _]rot:?\s*([0-9.eE+-]+)"}


def scrape_metrics(text: Column) -> list[Column]:
    """Numbers of a metric text; 0 where one is missing."""
    return [F.coalesce(F.regexp_extract(text, p, 1).try_cast("double"), F.lit(0.0)).alias(n) for n, p in METRIC.items()]


def average_metrics(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


# Trajectories


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, x, y, z, qx, qy, qz, qw of text lines; comments go."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    v = F.split(F.trim("value"), r"\s+")
    names = ["ts", "x", "y", "z", "qx", "qy", "qz", "qw"]
    return lines.select(F.input_file_name().alias("file"), *[F.get(v, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def tum_line(ts: Column, t: Column, q: Column) -> Column:
    """`ts tx ty tz qx qy qz qw` for writing with df.write.text."""
    return F.concat_ws(" ", ts.cast("string"), *[F.get(t, F.lit(i)).cast("string") for i in range(3)], *[F.get(q, F.lit(i)).cast("string") for i in range(4)])


def read_matrix_poses(spark: SparkSession, path: str) -> DataFrame:
    """file, at, pose (16): lines of 12 or 16 numbers, numbered in file order within a part of the file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("at", "line"))
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    last = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    return lines.where(F.length(F.trim("line")) > 0).select("file", "at", F.when(F.size(v) == 12, F.concat(v, last)).otherwise(v).alias("pose"))


# Point clouds


def ply_line(points: DataFrame) -> Column:
    """A data line of a text cloud: x y z, and r g b if there."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in ["x", "y", "z"] + [c for c in ("r", "g", "b") if c in points.columns]])


def ply_lines(points: DataFrame) -> DataFrame:
    """value: the data lines of a text cloud, for df.write.text; ply_header goes before."""
    return points.select(ply_line(points).alias("value"))


def ply_head(n: Column, colored: bool) -> Column:
    """The header of a text cloud of so many points."""
    lines = [f"property float {c}" for c in "xyz"] + ([f"property uchar {c}" for c in ("red", "green", "blue")] if colored else [])
    return F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), n.cast("string"), F.lit("\n" + "\n".join([*lines, "end_header"])))


def ply_header(n: int, colored: bool) -> str:
    lines = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
    lines += [f"property uchar {c}" for c in ("red", "green", "blue")] if colored else []
    return "\n".join([*lines, "end_header"])


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, r, g, b of text clouds as ply_head and ply_line write them; colours are null where there are none. Lines are read apart."""
    v = F.split("value", " ")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[-+0-9]") & (F.size(v) >= 3))
    number = lambda i, t: F.get(v, F.lit(i)).cast(t)
    return lines.select(F.input_file_name().alias("file"), *[number(i, "double").alias(c) for i, c in enumerate("xyz")], *[number(i, "int").alias(c) for i, c in enumerate("rgb", 3)])


def confident(conf: Column, least: float = 0.2) -> Column:
    """Whether the sigmoid of a confidence is over the least one."""
    return 1 / (1 + F.exp(-conf)) > least


def grid_shape(n: int) -> tuple[int, int]:
    """Rows and columns of a grid of n images."""
    rows = max(1, int(n**0.5))
    return rows, -(-n // rows)


def byte_range(value: Column, low: Column, high: Column) -> Column:
    """0 to 255 between low and high; 0 where they are equal."""
    return F.when(high > low, F.floor((value - low) / (high - low) * 255)).otherwise(0).cast("int")
