"""Reconstruction models as files: cameras, images and points, in text and binary form."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CAMERA, CAMERA_IDS, CAMERA_MODELS, IMAGE, POINT3D
from .storage import exists, opened, put

TABLES = {"cameras": CAMERA, "images": IMAGE, "points3D": POINT3D}


class Bytes:
    """Reads little-endian values one after another, from bytes or a mapped file."""

    def __init__(self, data: bytes | mmap.mmap):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("a name has no end")
        out = self.data[self.at : end].decode("utf-8")
        self.at = end + 1
        return out


def parse_cameras(data: bytes | mmap.mmap) -> Iterator[tuple]:
    f = Bytes(data)
    for _ in range(f.take("Q")[0]):
        camera, model, width, height = f.take("iiQQ")
        name, n = CAMERA_IDS[model]
        yield camera, name, width, height, list(f.take(f"{n}d"))


def parse_images(data: bytes | mmap.mmap) -> Iterator[tuple]:
    f = Bytes(data)
    for _ in range(f.take("Q")[0]):
        image, *pose, camera = f.take("idddddddi")
        name = f.text()
        flat = f.take("ddq" * f.take("Q")[0])
        yield image, pose[:4], pose[4:], camera, name, [list(p) for p in zip(flat[0::3], flat[1::3])], list(flat[2::3])


def parse_points(data: bytes | mmap.mmap) -> Iterator[tuple]:
    f = Bytes(data)
    for _ in range(f.take("Q")[0]):
        point, x, y, z, r, g, b, error = f.take("QdddBBBd")
        track = f.take("ii" * f.take("Q")[0])
        yield point, [x, y, z], [r, g, b], error, list(track[0::2]), list(track[1::2])


def _lines(data: bytes | Iterable[bytes], keep_empty: bool = False) -> Iterator[str]:
    """Lines of bytes or of a file, without comments."""
    for line in data.split(b"\n") if isinstance(data, bytes) else data:
        x = line.decode("utf-8").strip()
        if not x.startswith("#") and (x or keep_empty):
            yield x


def parse_cameras_text(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    for line in _lines(data):
        camera, model, width, height, *params = line.split()
        yield int(camera), model, int(width), int(height), [float(x) for x in params]


def parse_images_text(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    """Two lines an image; the second, its points, may be empty."""
    lines = _lines(data, keep_empty=True)
    for line in lines:
        if not line:
            continue
        head = line.split(maxsplit=9)
        points = next(lines, "").split()
        xys = [[float(x), float(y)] for x, y in zip(points[0::3], points[1::3])]
        yield int(head[0]), [float(x) for x in head[1:5]], [float(x) for x in head[5:8]], int(head[8]), head[9], xys, [int(x) for x in points[2::3]]


def parse_points_text(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    for line in _lines(data):
        v = line.split()
        yield int(v[0]), [float(x) for x in v[1:4]], [int(x) for x in v[4:7]], float(v[7]), [int(x) for x in v[8::2]], [int(x) for x in v[9::2]]


PARSERS = {
    ("cameras", ".bin"): parse_cameras, ("images", ".bin"): parse_images, ("points3D", ".bin"): parse_points,
    ("cameras", ".txt"): parse_cameras_text, ("images", ".txt"): parse_images_text, ("points3D", ".txt"): parse_points_text,
}
BATCH = 5_000


def read_table(spark: SparkSession, pattern: str, table: str, ext: str) -> DataFrame:
    """Rows of all files of one table that match a path pattern, with their path: files are read in parallel, and a file of any
    size comes out in batches. Text is read line by line, and a local binary file is mapped, so neither is held
    whole; binary files of other file systems are."""
    parse, schema = PARSERS[table, ext], TABLES[table]
    names = [x.split()[0] for x in schema.split(", ") if " " in x]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                held = []
                with opened(path, ext == ".bin") as content:
                    for row in parse(content):
                        held.append((path, *row))
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=["path", *names])
                            held = []
                yield pd.DataFrame(held, columns=["path", *names])

    files = spark.read.format("binaryFile").load(pattern).select("path")  # contents are not read here
    return files.mapInPandas(rows, "path string, " + schema)


def detect_format(folder: str, ext: str = "") -> str | None:
    """The form in which a folder holds all three tables: the given one, else binary, else text."""
    for e in [ext] if ext else [".bin", ".txt"]:
        if all(exists(f"{folder.rstrip('/')}/{t}{e}") for t in TABLES):
            return e
    return None


def list_formats(spark: SparkSession, root: str) -> DataFrame:
    """folder, ext: the folders below a root that hold all three tables in one form; binary goes before text. Only names are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(root).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)(\.\w+)$", 1).alias("t"), F.regexp_extract("path", r"([^/]*)(\.\w+)$", 2).alias("ext"))
    whole = files.where(F.col("t").isin(*TABLES) & F.col("ext").isin(".bin", ".txt")).groupBy("folder", "ext").agg(F.countDistinct("t").alias("n")).where(F.col("n") == len(TABLES))
    return whole.groupBy("folder").agg(F.min("ext").alias("ext"))


def read_model(spark: SparkSession, folder: str, ext: str = "") -> dict[str, DataFrame] | None:
    """cameras, images and points3D of a folder, or None if it holds no model."""
    found = detect_format(folder, ext)
    return {t: read_table(spark, f"{folder}/{t}{found}", t, found).drop("path") for t in TABLES} if found else None


# Sinks: a model is one folder of one reconstruction, written by one task.


def cameras_bytes(rows: list) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        out.append(struct.pack("<iiQQ", r.camera_id, CAMERA_MODELS[r.model][0], r.width, r.height) + struct.pack(f"<{len(r.params)}d", *r.params))
    return b"".join(out)


def images_bytes(rows: list) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        out.append(struct.pack("<idddddddi", r.image_id, *r.qvec, *r.tvec, r.camera_id) + r.name.encode("utf-8") + b"\0" + struct.pack("<Q", len(r.xys)))
        out += [struct.pack("<ddq", *xy, p) for xy, p in zip(r.xys, r.point3d_ids)]
    return b"".join(out)


def points_bytes(rows: list) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        out.append(struct.pack("<QdddBBBd", r.point3d_id, *r.xyz, *r.rgb, r.error) + struct.pack("<Q", len(r.image_ids)))
        out += [struct.pack("<ii", *t) for t in zip(r.image_ids, r.point2d_idxs)]
    return b"".join(out)


def _text(lines: list[str]) -> bytes:
    return ("\n".join(lines) + "\n").encode("utf-8")


def _mean(values: list[int]) -> float:
    return sum(values) / len(values) if values else 0.0


def cameras_text(rows: list) -> bytes:
    head = ["# Camera list with one line of data per camera:", "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]", f"# Number of cameras: {len(rows)}"]
    return _text(head + [" ".join(map(str, [r.camera_id, r.model, r.width, r.height, *r.params])) for r in rows])


def images_text(rows: list) -> bytes:
    mean = _mean([len(r.point3d_ids) for r in rows])
    head = ["# Image list with two lines of data per image:", "#   IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME", "#   POINTS2D[] as (X, Y, POINT3D_ID)", f"# Number of images: {len(rows)}, mean observations per image: {mean}"]
    lines = []
    for r in rows:
        lines.append(" ".join(map(str, [r.image_id, *r.qvec, *r.tvec, r.camera_id, r.name])))
        lines.append(" ".join(f"{x} {y} {p}" for (x, y), p in zip(r.xys, r.point3d_ids)))
    return _text(head + lines)


def points_text(rows: list) -> bytes:
    mean = _mean([len(r.image_ids) for r in rows])
    head = ["# 3D point list with one line of data per point:", "#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)", f"# Number of points: {len(rows)}, mean track length: {mean}"]
    return _text(head + [" ".join(map(str, [r.point3d_id, *r.xyz, *r.rgb, r.error, *[v for t in zip(r.image_ids, r.point2d_idxs) for v in t]])) for r in rows])


WRITERS = {
    ("cameras", ".bin"): cameras_bytes, ("images", ".bin"): images_bytes, ("points3D", ".bin"): points_bytes,
    ("cameras", ".txt"): cameras_text, ("images", ".txt"): images_text, ("points3D", ".txt"): points_text,
}


def write_models(df: DataFrame, table: str, folder_col: str, order: str, ext: str = ".bin") -> DataFrame:
    """Writes one file a folder named by folder_col, and returns (folder, path, rows), lazily. A folder is one
    reconstruction, whose model has to fit in a task as its file is one object with a count up front."""
    write = WRITERS[table, ext]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"{key[0].rstrip('/')}/{table}{ext}"
        rows = list(pdf.sort_values(order).itertuples(index=False))
        put(path, write(rows))
        return pd.DataFrame({"folder": [key[0]], "path": [path], "rows": [len(rows)]})

    return df.groupBy(folder_col).applyInPandas(each, "folder string, path string, rows long")


def normalised(images: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, image_id, name, idx, x, y, point3d_id: one row per keypoint of the images' arrays."""
    zipped = F.arrays_zip("xys", "point3d_ids")
    rows = images.select(*keys, "image_id", "name", F.posexplode(zipped).alias("idx", "o"))
    return rows.select(*keys, "image_id", "name", "idx", F.get("o.xys", F.lit(0)).alias("x"), F.get("o.xys", F.lit(1)).alias("y"), F.col("o.point3d_ids").alias("point3d_id"))
