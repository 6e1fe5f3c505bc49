"""Queries that write the tables with a sink, read them back with its source, and so run both.

Files go to the shared folder. Names of scenes and reconstructions are put into paths in hexadecimal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as gr
from ..scale import Workspace
from ..session import table
from ..sources import database as db
from ..sources import files, images, models, storage

KEYS = ["scene", "recon"]


def _folder(spark: SparkSession, name: str) -> str:
    return Workspace(spark, name).root


def _place(root: str) -> Column:
    return F.concat_ws("/", F.lit(root), F.hex(F.encode("scene", "utf-8")), F.concat(F.lit("r"), F.hex(F.encode("recon", "utf-8"))))


def _of_path(path: Column, last: int) -> list[Column]:
    """scene and recon from a path whose folders end so many parts before the last."""
    part = lambda i: F.element_at(F.split(path, "/"), i)
    text = lambda c: F.decode(F.unhex(c), "utf-8")
    return [text(part(-2 - last)).alias("scene"), text(F.substring(part(-1 - last), 2, 1 << 20)).alias("recon")]


def _done(written: DataFrame) -> None:
    """Runs a sink, and stops at its first error."""
    # An aggregate runs all tasks at once; limit would run a few of them, then more and more.
    bad = written.where("error is not null").agg(F.min(F.struct("path", "error")).alias("b")).first()["b"] if "error" in written.columns else None
    if bad:
        raise OSError(f"{bad['path']}: {bad['error']}")
    if "error" not in written.columns:
        written.write.format("noop").mode("overwrite").save()


# Reconstruction models


def _model(spark: SparkSession, rows: DataFrame, name: str, order: str, ext: str) -> DataFrame:
    root = _folder(spark, "models")
    _done(models.write_models(rows.withColumn("folder", _place(root)), name, "folder", order, ext))
    back = models.read_table(spark, f"{root}/*/*/{name}{ext}", name, ext)
    return back.select(*_of_path(F.col("path"), 1), *[c for c in back.columns if c != "path"])


def _camera_files(ext: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "camera").where("width is not null and height is not null and params is not null").distinct()
        back = _model(spark, rows, "cameras", "camera_id", ext)
        return back.select(*KEYS, "camera_id", "model", "width", "height", F.size("params").cast("long").alias("n"), F.round(F.get("params", F.lit(0)), 6).alias("first"), F.round(F.get("params", F.size("params") - 1), 6).alias("last"))

    return query


def _image_files(ext: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        seen = table(spark, sf_dir, "observation").select(*KEYS, "image_id", "idx", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "point3d_id").distinct()
        seen = seen.groupBy(*KEYS, "image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "point3d_id"))).alias("o"))
        rows = table(spark, sf_dir, "image").where("camera_id is not null").select(*KEYS, "image_id", "qvec", "tvec", "camera_id", "name").distinct().join(seen, [*KEYS, "image_id"])
        rows = rows.withColumn("xys", F.transform("o", lambda o: F.array(o["x"], o["y"]))).withColumn("point3d_ids", F.transform("o", lambda o: o["point3d_id"])).drop("o")
        back = _model(spark, rows, "images", "image_id", ext)
        points = models.normalised(back.select(*KEYS, "image_id", "name", "xys", "point3d_ids"), KEYS).groupBy(*KEYS, "image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * (F.col("idx") + 1)), 3).alias("xs"), F.round(F.sum("y"), 3).alias("ys"), F.sum("point3d_id").alias("ids"))
        poses = back.select(*KEYS, "image_id", "name", F.col("camera_id").cast("long").alias("camera_id"), F.round(F.get("qvec", F.lit(0)), 9).alias("qw"), F.round(F.get("qvec", F.lit(3)), 9).alias("qz"), F.round(F.get("tvec", F.lit(2)), 9).alias("tz"))
        return poses.join(points, [*KEYS, "image_id"])

    return query


def _point_files(ext: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz", "rgb", F.coalesce("error", F.lit(-1.0)).alias("error"), "image_ids", "point2d_idxs").distinct()
        back = _model(spark, rows, "points3D", "point3d_id", ext)
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
        return back.select(*KEYS, "point3d_id", *[F.round(F.get("xyz", F.lit(i)), 9).alias(c) for i, c in enumerate("xyz")], total("rgb").alias("rgb"), F.round("error", 9).alias("error"), F.size("image_ids").cast("long").alias("n"), total("image_ids").alias("images"), total("point2d_idxs").alias("places"))

    return query


def model_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with the form in which they hold a whole model: those of odd camera counts have text only."""
    root = _folder(spark, "formats")
    cams = table(spark, sf_dir, "camera").groupBy(*KEYS).agg(F.countDistinct("camera_id").alias("k"))
    names = F.explode(F.array(*[F.lit(t) for t in models.TABLES])).alias("t")
    text = cams.select(_place(root).alias("folder"), F.lit(".txt").alias("ext"), names)
    binary = cams.where("k % 2 = 0").select(_place(root).alias("folder"), F.lit(".bin").alias("ext"), names)
    _done(storage.write_files(text.unionAll(binary).select(F.concat("folder", F.lit("/"), "t", "ext").alias("path"), F.lit("#").alias("content")), "path", "content"))
    held = models.list_formats(spark, root)
    return held.select(*_of_path(F.concat("folder", F.lit("/x")), 1), "ext")


# Match databases


def match_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One database for each reconstruction, written by as many tasks; then verified pairs with more than 16 matches, by name."""
    root = _folder(spark, "databases").removeprefix("file://")
    named = table(spark, sf_dir, "presampling_pairs").withColumns({c: gr.flat_name(F.col(c)) for c in ("src", "dst")})
    pairs = gr.build_graph(named, ["loaded_at", "matched_at"], KEYS, least=0)
    from pyspark.sql.window import Window

    nodes = gr.nodes_of(pairs, KEYS).select(*KEYS, "id", F.row_number().over(Window.partitionBy(*KEYS).orderBy("id")).alias("image_id"))
    ids = Workspace(spark, "ids").write(nodes).df
    path = F.concat(F.concat_ws("-", F.lit(root + "/d"), F.hex(F.encode("scene", "utf-8")), F.hex(F.encode("recon", "utf-8"))), F.lit(".db"))
    rows_i = ids.select(path.alias("path"), F.col("image_id").cast("long").alias("image_id"), F.col("id").alias("name"), F.lit(1).cast("long").alias("camera_id"))
    coded = pairs.join(ids.toDF(*KEYS, "src", "a"), [*KEYS, "src"]).join(ids.toDF(*KEYS, "dst", "b"), [*KEYS, "dst"])
    blob = db.array_blob("<u4")(F.array("a", "b"))
    rows_m = coded.select(path.alias("path"), gr.pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.col("weight").alias("rows"), F.lit(2).cast("long").alias("cols"), F.when(F.col("weight") % 7 != 0, blob).alias("data"), F.lit(2).cast("long").alias("config"))
    _done(db.write_databases(rows_i, "path", "images"))
    _done(db.write_databases(rows_m, "path", "two_view_geometries"))
    back = db.read_pairs(spark, f"{root}/*.db", parts=2)
    name = F.split(F.regexp_extract("path", r"([^/]*)\.db$", 1), "-")
    text = lambda i: F.decode(F.unhex(F.get(name, F.lit(i))), "utf-8")
    return back.select(text(1).alias("scene"), text(2).alias("recon"), "src", "dst", "matches_num")


def blob_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point ids of images to a blob and back."""
    rows = table(spark, sf_dir, "image").select(*KEYS, "image_id", "point3d_ids").distinct()
    back = rows.select(*KEYS, "image_id", db.blob_array("<i8", "bigint")(db.array_blob("<i8")("point3d_ids")).alias("p"))
    return back.select(*KEYS, "image_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, b: a * 31 % 1000003 + b).alias("code"))


def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one match for pairs in either order: canonical pairs, to blobs and back."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).cast("int").alias("a"), (F.col("event_id") % 60).cast("int").alias("b")).where("a <> b")
    m = db.canonical_matches(e.withColumn("m", F.array(F.struct(F.lit(5).alias("i"), (F.col("event_id") % 9).cast("int").alias("j")))), "a", "b", "m")
    blobs = m.select("pair_id", db.array_blob("<u4")(F.array(F.get("matches", F.lit(0))["i"], F.get("matches", F.lit(0))["j"])).alias("data"))
    back = blobs.select("pair_id", F.inline(db.match_pairs(F.col("data"))))
    a, b = gr.pair_images(F.col("pair_id"))
    return back.groupBy(a.alias("a"), b.alias("b"), "i", "j").agg(F.count(F.lit(1)).alias("n"))


# Depth files


def _positive(e: pd.Series) -> pd.Series:
    return e.map(lambda a: (np.maximum(np.asarray(a, np.float64), 0) * 10).astype("<f4").tobytes())


def _steps(e: pd.Series) -> pd.Series:
    """Depths in 64ths, which half floats hold exactly."""
    return e.map(lambda a: (np.floor(np.maximum(np.asarray(a, np.float64), 0) * 640) / 64).astype("<f4").tobytes())


def _depth_files(kind: str, values=_positive):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _folder(spark, "depths")
        rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
        rows = rows.select(F.concat(F.lit(f"{root}/"), F.col("label"), F.lit("/"), F.col("vec_id"), F.lit(".depth")).alias("path"), F.lit(4).alias("h"), F.lit(16).alias("w"), F.pandas_udf(values, "binary")("embedding").alias("data"))
        _done(files.write_depths(rows, kind))
        back = files.read_depths(spark, root, kind, "*.depth").where("error is null")
        px = files.pixels(back.withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.depth$", 1).cast("long")), ["vec_id"])
        return px.groupBy("vec_id").agg(F.round(F.sum(F.col("z") * (1 + F.col("v") * 16 + F.col("u"))), 3).alias("placed"), F.count_if(F.col("z") > 0).alias("valid"))

    return query


# Images


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of image files with sizes, orientations and lenses made of cameras and images; those that pass the filter."""
    root = _folder(spark, "images")
    cams = table(spark, sf_dir, "camera").where("width is not null and height is not null").groupBy(*KEYS, "camera_id").agg(F.min("width").alias("width"), F.min("height").alias("height"))
    rows = table(spark, sf_dir, "image").select(*KEYS, "image_id", "camera_id", "name").distinct().join(cams, [*KEYS, "camera_id"])
    path = F.concat(_place(root), F.lit("/"), F.col("image_id"), F.when(F.col("image_id") % 6 == 0, "pano.jpg").otherwise(".jpg"))

    def head(i: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        meta = lambda k: None if k % 5 == 0 else {"make": "Maker", "orientation": k % 8 + 1, "lens": "Fisheye 8" if k % 7 == 0 else "Prime lens", "focal35": 8 if k % 11 == 0 else 35, "focal": 2 if k % 13 == 0 else 28}
        return pd.Series([images.jpeg_head(int(b), int(c), meta(int(a))) if a % 17 else b"no image" for a, b, c in zip(i, w, h)])

    content = F.pandas_udf(head, "binary")("image_id", "width", "height")
    _done(storage.write_files(rows.select(path.alias("path"), content.alias("content")), "path", "content"))
    kept = images.kept_images(images.read_metadata(spark, root))
    return kept.select(*_of_path(F.col("path"), 1), F.regexp_extract("path", r"(\d+)(pano)?\.jpg$", 1).cast("int").alias("image_id"), "width", "height", "has_exif", F.coalesce("orientation", F.lit(0)).alias("orientation"), "make", "lens")


# Lists, metrics, trajectories, clouds


def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON list of names for each split."""
    root = _folder(spark, "lists")
    rows = table(spark, sf_dir, "recon_split").where("split is not null and scene_recon_name is not null").select("split", "scene_recon_name").distinct()
    lists = rows.groupBy("split").agg(F.to_json(F.array_sort(F.collect_list("scene_recon_name"))).alias("content"))
    _done(storage.write_files(lists.select(F.concat(F.lit(f"{root}/"), "split", F.lit(".json")).alias("path"), "content"), "path", "content"))
    out = None
    for split in ("train", "val", "test"):
        if storage.exists(f"{root}/{split}.json"):
            one = files.read_split_list(spark, f"{root}/{split}.json").select(F.lit(split).alias("split"), *KEYS)
            out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], "split string, scene string, recon string")


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of lists of images for each scene."""
    root = _folder(spark, "sequences")
    seqs = table(spark, sf_dir, "image").groupBy("scene", "recon").agg(F.array_sort(F.collect_set("image_id")).alias("ids"))
    one = seqs.groupBy("scene").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat("scene", F.lit(">"), "recon").alias("k"), "ids")))).alias("content"))
    _done(storage.write_files(one.select(F.concat(F.lit(f"{root}/"), F.hex(F.encode("scene", "utf-8")), F.lit(".json")).alias("path"), "content"), "path", "content"))
    return files.read_sequence_ids(spark, f"{root}/*.json").select("seq", "pos", "id")


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric file for each user, with a row for every event: the last one counts."""
    root = _folder(spark, "metrics")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    line = F.concat_ws(",", F.concat(F.lit("u"), "user_id"), "event_type", F.col("value").cast("string"))
    text = e.groupBy("user_id").agg(F.concat(F.lit("user,kind,value\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda s: s["l"]), "\n"), F.lit("\n")).alias("content"))
    _done(storage.write_files(text.select(F.concat(F.lit(f"{root}/"), "user_id", F.lit(".csv")).alias("path"), "content"), "path", "content"))
    return files.gather_csv(spark, root).select("user", "kind", F.round(F.col("value").cast("double"), 4).alias("value"))


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers scraped of metric texts, some of which lack one, and their means."""
    root = _folder(spark, "texts")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("m"), F.round(F.max("value"), 4).alias("x"))
    text = F.concat(F.lit("ATE: "), F.col("m").cast("string"), F.lit("\nRPE trans: "), F.col("x").cast("string"), F.when(F.col("user_id") % 3 == 0, "\n").otherwise("\nRPE rot: 1.5\n"))
    _done(storage.write_files(u.select(F.concat(F.lit(f"{root}/sub/"), "user_id", F.lit("_metric.txt")).alias("path"), text.alias("content")), "path", "content"))
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_metric.txt").text(root, wholetext=True).select(*files.scrape_metrics(F.col("value")))
    out = files.average_metrics(rows, list(files.METRIC))
    return out.select(*[F.round(c, 6).alias(c) for c in files.METRIC])


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").where("qvec is not null and tvec is not null").groupBy(*KEYS, "image_id").agg(F.min(F.struct("qvec", "tvec")).alias("p")).select(*KEYS, "image_id", "p.*")


def trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as text lines of time, position and quaternion, and back."""
    root = _folder(spark, "trajectories")
    q = F.array(*[F.get("qvec", F.lit(i)) for i in (1, 2, 3, 0)])
    rows = _posed(spark, sf_dir).select(*KEYS, "image_id", files.tum_line(F.col("image_id").cast("double"), F.col("tvec"), q).alias("l"))
    text = rows.groupBy(*KEYS).agg(F.concat(F.lit("# time x y z qx qy qz qw\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "l"))), lambda s: s["l"]), "\n")).alias("content"))
    _done(storage.write_files(text.select(F.concat(_place(root), F.lit("/t.txt")).alias("path"), "content"), "path", "content"))
    back = files.read_tum(spark, f"{root}/*/*/t.txt")
    return back.select(*_of_path(F.col("file"), 1), F.col("ts").cast("int").alias("image_id"), *[F.round(c, 9).alias(c) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")])


def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as lines of 12 numbers, and back."""
    root = _folder(spark, "matrices")
    m = g.rigid(g.quat_wxyz_to_matrix(F.col("qvec")), F.col("tvec"))
    line = F.array_join(F.transform(F.slice(m, 1, 12), lambda v: v.cast("string")), " ")
    text = _posed(spark, sf_dir).select(*KEYS, "image_id", line.alias("l")).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "l"))), lambda s: s["l"]), "\n").alias("content"))
    _done(storage.write_files(text.select(F.concat(_place(root), F.lit("/m.txt")).alias("path"), "content"), "path", "content"))
    back = files.read_matrix_poses(spark, f"{root}/*/*/m.txt")
    return back.select(*_of_path(F.col("file"), 1), "at", *[F.round(F.get("pose", F.lit(i)), 9).alias(f"m{i}") for i in (0, 3, 5, 11, 15)])


def cloud_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point clouds as text with a header, one for each reconstruction, and their points read back."""
    root = _folder(spark, "clouds")
    p = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", *[F.get("xyz", F.lit(i)).alias(c) for i, c in enumerate("xyz")], *[F.get("rgb", F.lit(i)).cast("int").alias(c) for i, c in enumerate("rgb")]).where("x is not null").distinct()
    lines = p.select(*KEYS, "point3d_id", files.ply_line(p).alias("l")).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("point3d_id", "l"))).alias("s"))
    text = lines.select(F.concat(_place(root), F.lit("/c.ply")).alias("path"), F.concat(files.ply_head(F.size("s"), True), F.lit("\n"), F.array_join(F.transform("s", lambda s: s["l"]), "\n"), F.lit("\n")).alias("content"))
    _done(storage.write_files(text, "path", "content"))
    back = files.read_ply(spark, f"{root}/*/*/c.ply")
    return back.groupBy(*_of_path(F.col("file"), 1)).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"], F.sum(F.col("r") + F.col("g") + F.col("b")).cast("long").alias("rgb"))


QUERIES = {f"{n}_{k}": f(e) for n, f in (("cameras", _camera_files), ("images", _image_files), ("points", _point_files)) for k, e in (("text", ".txt"), ("binary", ".bin"))}
QUERIES |= {f"depths_{k}": _depth_files(k) for k in ("mvs", "npy", "sintel")} | {"depths_half_png": _depth_files("half_png", _steps), "depths_scaled_png": _depth_files("png_1000")}
QUERIES |= {f.__name__: f for f in (model_formats, match_databases, blob_arrays, match_lists, image_files, split_lists, sequence_ids, metric_files, metric_texts, trajectory_files, matrix_files, cloud_files)}

_CODE = "list_reduce(list_prepend(0::BIGINT, p), lambda a, b: a * 31 % 1000003 + b)"
_CAMERAS = "SELECT DISTINCT scene, recon, camera_id, model, width, height, len(params) AS n, round(params[1], 6) AS first, round(params[-1], 6) AS last FROM camera WHERE width IS NOT NULL AND height IS NOT NULL AND params IS NOT NULL"
_IMAGES = """
    WITH o AS (SELECT DISTINCT scene, recon, image_id, idx, coalesce(x, 0) AS x, coalesce(y, 0) AS y, point3d_id FROM observation),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene, recon, image_id ORDER BY idx, x, y, point3d_id) AS r FROM o),
    p AS (SELECT scene, recon, image_id, count(*) AS n, round(sum(x * r), 3) AS xs, round(sum(y), 3) AS ys, sum(point3d_id)::BIGINT AS ids FROM k GROUP BY ALL),
    i AS (SELECT DISTINCT scene, recon, image_id, qvec, tvec, camera_id, name FROM image WHERE camera_id IS NOT NULL)
    SELECT scene, recon, image_id, name, camera_id::BIGINT AS camera_id, round(qvec[1], 9) AS qw, round(qvec[4], 9) AS qz, round(tvec[3], 9) AS tz, n, xs, ys, ids FROM i JOIN p USING (scene, recon, image_id)"""
_POINTS = """
    WITH p AS (SELECT DISTINCT scene, recon, point3d_id, xyz, rgb, coalesce(error, -1) AS error, image_ids, point2d_idxs FROM point3d)
    SELECT scene, recon, point3d_id, round(xyz[1], 9) + 0 AS x, round(xyz[2], 9) + 0 AS y, round(xyz[3], 9) + 0 AS z, list_sum(rgb)::BIGINT AS rgb, round(error, 9) AS error,
           len(image_ids) AS n, coalesce(list_sum(image_ids), 0)::BIGINT AS images, coalesce(list_sum(point2d_idxs), 0)::BIGINT AS places FROM p"""
_DEPTH = "SELECT vec_id, round(sum((greatest(embedding[i]::DOUBLE, 0) * 10)::FLOAT::DOUBLE * i), 3) AS placed, count_if(embedding[i] > 0)::BIGINT AS valid FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE len(embedding) = 64 GROUP BY vec_id"
_POSE = "p AS (SELECT scene, recon, image_id, min({'qvec': qvec, 'tvec': tvec}) AS p FROM image WHERE qvec IS NOT NULL AND tvec IS NOT NULL GROUP BY ALL)"
SQL = {
    "cameras_text": _CAMERAS, "cameras_binary": _CAMERAS, "images_text": _IMAGES, "images_binary": _IMAGES, "points_text": _POINTS, "points_binary": _POINTS,
    "depths_mvs": _DEPTH, "depths_npy": _DEPTH, "depths_sintel": _DEPTH,
    "depths_half_png": _DEPTH.replace("(greatest(embedding[i]::DOUBLE, 0) * 10)::FLOAT::DOUBLE", "floor(greatest(embedding[i]::DOUBLE, 0) * 640) / 64").replace("embedding[i] > 0", "embedding[i]::DOUBLE * 640 >= 1"),
    "depths_scaled_png": """
        WITH z AS (SELECT vec_id, i, round_even((greatest(embedding[i]::DOUBLE, 0) * 10)::FLOAT * 1000, 0)::BIGINT AS m FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE len(embedding) = 64)
        SELECT vec_id, round(sum(i * CASE WHEN m = 0 THEN -1 ELSE m / 1000 END), 3) AS placed, count_if(m > 0)::BIGINT AS valid FROM z GROUP BY vec_id""",
    "model_formats": "SELECT scene, recon, CASE WHEN count(DISTINCT camera_id) % 2 = 0 THEN '.bin' ELSE '.txt' END AS ext FROM camera GROUP BY scene, recon",
    "match_databases": """
        WITH r AS (SELECT scene, recon, least(replace(src, ' ', '_'), replace(dst, ' ', '_')) AS src, greatest(replace(src, ' ', '_'), replace(dst, ' ', '_')) AS dst, matches_num, loaded_at, matched_at
                   FROM presampling_pairs WHERE matches_num > 0 AND replace(src, ' ', '_') <> replace(dst, ' ', '_')),
        m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY scene, recon, src, dst ORDER BY loaded_at DESC, matched_at DESC, matches_num DESC) = 1)
        SELECT scene, recon, src, dst, matches_num FROM m WHERE matches_num > 16 AND matches_num % 7 <> 0""",
    "blob_arrays": f"WITH d AS (SELECT DISTINCT scene, recon, image_id, point3d_ids AS p FROM image) SELECT scene, recon, image_id, len(p) AS n, {_CODE} AS code FROM d",
    "match_lists": """
        WITH e AS (SELECT user_id % 50 AS a, event_id % 60 AS b, event_id % 9 AS j FROM events WHERE user_id % 50 <> event_id % 60)
        SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN j ELSE 5 END AS i, CASE WHEN a > b THEN 5 ELSE j END AS j, count(*) AS n FROM e GROUP BY ALL""",
    "image_files": """
        WITH c AS (SELECT scene, recon, camera_id, min(width) AS width, min(height) AS height FROM camera WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY ALL),
        i AS (SELECT DISTINCT scene, recon, image_id, camera_id, name FROM image),
        j AS (SELECT i.*, width, height, image_id % 5 <> 0 AS e, greatest(width, height) / least(width, height) >= 3 OR image_id % 6 = 0 AS wide,
              image_id % 7 = 0 OR image_id % 13 = 0 OR image_id % 11 = 0 AS round FROM i JOIN c USING (scene, recon, camera_id) WHERE image_id % 17 <> 0)
        SELECT scene, recon, image_id, width::INT AS width, height::INT AS height, e AS has_exif, CASE WHEN e THEN image_id % 8 + 1 ELSE 0 END::INT AS orientation,
               CASE WHEN e THEN 'maker' ELSE '' END AS make, CASE WHEN e THEN 'prime lens' ELSE '' END AS lens FROM j WHERE NOT e OR NOT (round OR wide)""",
    "split_lists": "SELECT DISTINCT split, split_part(scene_recon_name, '>', 1) AS scene, regexp_extract(scene_recon_name, '[^>]*$') AS recon FROM recon_split WHERE split IS NOT NULL AND scene_recon_name IS NOT NULL",
    "sequence_ids": """
        WITH d AS (SELECT DISTINCT scene || '>' || recon AS seq, image_id FROM image WHERE image_id IS NOT NULL)
        SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY image_id) - 1)::INT AS pos, image_id AS id FROM d""",
    "metric_files": 'SELECT \'u\' || user_id AS "user", event_type AS kind, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1',
    "metric_texts": """
        WITH u AS (SELECT user_id, round(avg(value), 4) AS m, round(max(value), 4) AS x FROM events GROUP BY user_id)
        SELECT round(avg(m), 6) AS ate, round(avg(x), 6) AS rpe_trans, round(avg(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1.5 END), 6) AS rpe_rot FROM u""",
    "trajectory_files": f"""
        WITH {_POSE} SELECT scene, recon, image_id, round(p.tvec[1], 9) AS x, round(p.tvec[2], 9) AS y, round(p.tvec[3], 9) AS z,
            round(p.qvec[2], 9) AS qx, round(p.qvec[3], 9) AS qy, round(p.qvec[4], 9) AS qz, round(p.qvec[1], 9) AS qw FROM p""",
    "matrix_files": f"""
        WITH {_POSE}, q AS (SELECT scene, recon, image_id, p.qvec[1] AS w, p.qvec[2] AS x, p.qvec[3] AS y, p.qvec[4] AS z, p.tvec AS t FROM p)
        SELECT scene, recon, (row_number() OVER (PARTITION BY scene, recon ORDER BY image_id) - 1)::INT AS at, round(1-2*(y*y+z*z), 9) AS m0, round(t[1], 9) AS m3, round(1-2*(x*x+z*z), 9) AS m5, round(t[3], 9) AS m11, 1.0::DOUBLE AS m15 FROM q""",
    "cloud_files": """
        WITH p AS (SELECT DISTINCT scene, recon, point3d_id, xyz, rgb FROM point3d WHERE xyz[1] IS NOT NULL)
        SELECT scene, recon, count(*) AS n, round(sum(xyz[1]), 4) AS x, round(sum(xyz[2]), 4) AS y, round(sum(xyz[3]), 4) AS z, sum(list_sum(rgb))::BIGINT AS rgb FROM p GROUP BY ALL""",
}
