import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.sources import database as db
from viewgraph.sources import files, models


@pytest.fixture(scope="module")
def tables(spark):
    cams = spark.createDataFrame([(1, "SIMPLE_PINHOLE", 640, 480, [500.0, 320.0, 240.0]), (2, "OPENCV", 10, 20, [1.0, 2.0, 3.0, 4.0, 0.1, 0.2, 0.3, 0.4])], models.CAMERA)
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.5, 0.25, 4.0], 1, "a b_ü.jpg", [[1.5, 2.5], [3.0, 4.0]], [7, -1]), (2, [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0], 2, "c.jpg", [], [])], models.IMAGE)
    points = spark.createDataFrame([(7, [1.0, 2.0, 3.0], [10, 20, 255], 0.5, [1], [0]), (8, [0.0, 0.0, 0.0], [0, 0, 0], 1.5, [], [])], models.POINT3D)
    return {"cameras": cams, "images": images, "points3D": points}


@pytest.mark.parametrize("ext", [".bin", ".txt"])
def test_models_go_round(spark, tables, tmp_path, ext):
    tmp_path = tmp_path / "a b%20c"
    for name, df in tables.items():
        models.write_models(df.withColumn("folder", F.lit(str(tmp_path))), name, "folder", df.columns[0], ext).collect()
    assert models.detect_format(str(tmp_path)) == ext
    back = models.read_model(spark, str(tmp_path))
    for name, df in tables.items():
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, df.collect()))
    assert models.normalised(back["images"]).count() == 2
    assert models.read_model(spark, str(tmp_path / "none")) is None
    (tmp_path / f"cameras{ext}").write_bytes(b"")  # an empty file has no row, and stops nothing
    assert models.read_table(spark, str(tmp_path / f"cameras{ext}"), "cameras", ext).collect() == []


def test_text_headers_hold_means(spark, tables, tmp_path):
    models.write_models(tables["images"].withColumn("folder", F.lit(str(tmp_path))), "images", "folder", "image_id", ".txt").collect()
    assert "mean observations per image: 1.0" in (tmp_path / "images.txt").read_text()


def test_database_pushes_filters_down(spark, tmp_path):
    path = str(tmp_path / "d.db")
    con = db.create(path)
    con.executemany("INSERT INTO images (image_id, name, camera_id) VALUES (?, ?, 1)", [(1, "a b"), (2, "c"), (3, "d")])
    base = 2**31 - 1
    blob = np.array([[0, 1], [5, 6]], "<u4").tobytes()
    con.executemany("INSERT INTO two_view_geometries (pair_id, rows, cols, data, config) VALUES (?, ?, 2, ?, 2)", [(base + 2, 17, blob), (base + 3, 16, blob), (2 * base + 3, 99, None)])
    con.commit()
    con.close()
    assert [tuple(r) for r in db.read_pairs(spark, path, parts=3).collect()] == [("a_b", "c", 17)]
    geometry = db.read(spark, path, "two_view_geometries", ["pair_id", "data"])
    assert geometry.columns == ["pair_id", "data"] and geometry.count() == 3
    got = geometry.where("data is not null").select(db.match_pairs(F.col("data")).alias("m")).first().m
    assert [tuple(x) for x in got] == [(0, 1), (5, 6)]


def test_database_round_trip(spark, tmp_path):
    path = str(tmp_path / "e.db")
    rows = spark.createDataFrame([(1, 0, 10, 20, [1.0, 2.5], 1)], "camera_id long, model long, width long, height long, p array<double>, prior_focal_length long")
    assert db.write(rows.withColumn("params", db.array_blob("<f8")("p")).drop("p"), path, "cameras") == 1
    back = db.read(spark, path, "cameras").select("camera_id", db.blob_array("<f8", "double")("params").alias("p")).first()
    assert (back.camera_id, back.p) == (1, [1.0, 2.5])
    m = spark.createDataFrame([(2, 1, [(5, 6)])], "a int, b int, m array<struct<i int, j int>>")
    row = db.canonical_matches(m, "a", "b", "m").first()
    assert (row.pair_id, row.matches[0].i, row.matches[0].j) == (2**31 - 1 + 2, 6, 5)


def test_depth_files(spark, tmp_path):
    z = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jpg.geometric.bin").write_bytes(files.mvs_bytes(z))
    (tmp_path / "b.jpg.geometric.bin").write_bytes(b"no")
    rows = {r.path.split("/")[-1]: r for r in files.read_depths(spark, str(tmp_path), "mvs", "*.geometric.bin").collect()}
    good, bad = rows["a.jpg.geometric.bin"], rows["b.jpg.geometric.bin"]
    assert (good.h, good.w) == (2, 3) and np.frombuffer(good.data, "<f4").tolist() == z.ravel().tolist() and good.error is None
    assert bad.data is None and "ValueError" in bad.error
    assert (files.sintel_depth(struct.pack("<fii", files.SINTEL_TAG, 3, 2) + z.tobytes()) == z).all()
    assert files.half_float(np.array([[15360]])).tolist() == [[1.0]]
    px = files.pixels(spark.createDataFrame([("a", 2, 3, z.tobytes())], "p string, h int, w int, data binary"), ["p"]).collect()
    assert {(r.v, r.u): r.z for r in px}[1, 2] == 5.0
    images = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "p string, h int, w int")
    depths = spark.createDataFrame([("a", b"12345678")], "p string, data binary")
    got = {r.p: (bytes(r.data), r.missing) for r in files.with_depth(images, depths, "p").collect()}
    assert got == {"a": (b"12345678", False), "b": (b"\0" * 8, True)}


def test_lists_metrics_and_trajectories(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(["a>0", "b>1"]))
    assert {(r.scene, r.recon) for r in files.read_split_list(spark, str(tmp_path / "s.json")).collect()} == {("a", "0"), ("b", "1")}
    (tmp_path / "m.json").write_text(json.dumps({"q": [3, 1]}))
    assert {(r.seq, r.pos, r.id) for r in files.read_sequence_ids(spark, str(tmp_path / "m.json")).collect()} == {("q", 0, 3), ("q", 1, 1)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.csv").write_text("v\n1\n2\n")
    (tmp_path / "c" / "two.csv").write_text("v\n5\n")
    assert {(r.file, r.v) for r in files.gather_csv(spark, str(tmp_path / "c")).collect()} == {("one.csv", 2), ("two.csv", 5)}
    with pytest.raises(Exception):
        files.gather_csv(spark, str(tmp_path / "none")).collect()
    (tmp_path / "t.txt").write_text("# c\n1.5 1 2 3 0 0 0 1\n")
    r = files.read_tum(spark, str(tmp_path / "t.txt")).first()
    assert (r.ts, r.z, r.qw) == (1.5, 3.0, 1.0)
    (tmp_path / "p.txt").write_text(" ".join(map(str, range(12))) + "\n")
    assert files.read_matrix_poses(spark, str(tmp_path / "p.txt")).first().pose[-4:] == [0, 0, 0, 1]
    text = spark.createDataFrame([("ATE: 0.5, RPE trans: 1e-2",), ("",)], "t string").select(*files.scrape_metrics(F.col("t"))).collect()
    assert [tuple(x) for x in text] == [(0.5, 0.01, 0.0), (0.0, 0.0, 0.0)]
    points = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert files.ply_lines(points).first().value == "1.0 2.0 3.0" and "element vertex 1" in files.ply_header(1, False)
    assert files.grid_shape(7) == (2, 4)


def test_png_of_all_kinds_and_filters():
    import zlib

    from viewgraph.sources import images

    rng = np.random.default_rng(1)
    for shape, dtype in (((3, 5), np.uint8), ((4, 6), np.uint16), ((2, 7, 3), np.uint8), ((5, 2, 4), np.uint16), ((1, 1, 2), np.uint8)):
        z = rng.integers(0, np.iinfo(dtype).max + 1, shape).astype(dtype)
        assert (images.read_png(images.png_bytes(z)) == z).all()
    z = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    lines = []
    for i in range(5):  # one line of each filter, by its definition
        row, above = z[i].ravel().astype(int), (z[i - 1].ravel().astype(int) if i else np.zeros(18, int))
        left, corner = np.r_[[0] * 3, row[:-3]], np.r_[[0] * 3, above[:-3]]
        near = np.select([(abs(above - corner) <= abs(left - corner)) & (abs(above - corner) <= abs(left + above - 2 * corner)), abs(left - corner) <= abs(left + above - 2 * corner)], [left, above], corner)
        lines.append(bytes([i]) + ((row - [0 * row, left, above, (left + above) // 2, near][i]) % 256).astype(np.uint8).tobytes())
    data = images.png_bytes(z)
    head = data[: data.index(b"IDAT") - 4]
    body = zlib.compress(b"".join(lines))
    assert (images.read_png(head + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0" * 4) == z).all()
    with pytest.raises(ValueError):
        images.read_png(b"GIF89a")


def test_metadata_of_images(spark, tmp_path):
    from viewgraph.sources import images

    meta = {"make": "ACME", "model": "X", "orientation": 6, "lens": "A long Fisheye lens", "focal": 2, "focal35": 9}
    (tmp_path / "a.jpg").write_bytes(images.jpeg_head(640, 480, meta))
    (tmp_path / "b.jpg").write_bytes(images.jpeg_head(9000, 10, None))
    (tmp_path / "c.png").write_bytes(images.png_bytes(np.zeros((3, 4), np.uint8)))
    (tmp_path / "d.jpg").write_bytes(b"no image")
    (tmp_path / "e.jpg").write_bytes(b"")
    (tmp_path / "f.jpg").write_bytes(images.jpeg_head(640, 480, {"orientation": 1}))
    (tmp_path / "g pano.jpg").write_bytes(images.jpeg_head(640, 480, {"orientation": 1}))
    rows = {r.path.rpartition("/")[2].replace("%20", " "): r for r in images.read_metadata(spark, str(tmp_path)).collect()}
    a = rows["a.jpg"]
    assert (a.width, a.height, a.has_exif, a.orientation, a.make, a.model, a.lens, a.focal, a.focal35) == (640, 480, True, 6, "acme", "x", "a long fisheye lens", 2, 9)
    assert (rows["c.png"].width, rows["c.png"].height, rows["c.png"].has_exif) == (4, 3, False)
    assert not rows["d.jpg"].readable and rows["d.jpg"].error and "e.jpg" not in rows
    kept = {r.path.rpartition("/")[2].replace("%20", " ") for r in images.kept_images(images.read_metadata(spark, str(tmp_path))).collect()}
    assert kept == {"b.jpg", "c.png", "f.jpg"}  # without EXIF an image stays whatever its shape


def test_files_are_written_whole_and_errors_are_rows(spark, tmp_path):
    from viewgraph.sources import storage

    (tmp_path / "file").write_text("x")
    df = spark.createDataFrame([(str(tmp_path / "a" / "b.txt"), "ü"), (f"file://{tmp_path}/c.txt", ""), (str(tmp_path / "file" / "d"), "x"), (None, "x"), (str(tmp_path / "e"), None)], "p string, c string")
    got = {r.path: (r.bytes, bool(r.error)) for r in storage.write_files(df, "p", "c").collect()}
    assert got[str(tmp_path / "a" / "b.txt")] == (2, False) and (tmp_path / "a" / "b.txt").read_text() == "ü"
    assert got[f"file://{tmp_path}/c.txt"] == (0, False) and sum(bad for _, bad in got.values()) == 3
    assert storage.exists(f"file://{tmp_path}/c.txt") and not storage.exists(str(tmp_path / "none"))


def test_many_databases(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / f"{k} x.db"), i, f"n {i}", 1) for k in "ab" for i in (1, 2)], "path string, image_id long, name string, camera_id long")
    assert all(r.error is None and r.rows == 2 for r in db.write_databases(rows, "path", "images").collect())
    db.write_databases(rows, "path", "images").collect()  # as a task that runs twice
    back = db.read(spark, str(tmp_path / "*.db"), "images", parts=2)
    assert back.count() == 4 and back.select("path").distinct().count() == 2
    assert back.where("image_id > 1 and path is not null").count() == 2
    assert db.read(spark, str(tmp_path / "*.none"), "images").collect() == []


def test_small_databases_share_partitions_that_the_driver_does_not_open(tmp_path, monkeypatch):
    for i in range(300):
        con = db.create(str(tmp_path / f"d{i:03}.db"), flushed=False)
        with con:
            con.executemany("INSERT INTO images (image_id, name, camera_id) VALUES (?, ?, 1)", [(k, f"n{k}") for k in range(1, 3 + i % 3)])
        con.close()
    reader = db.Reader(f"{tmp_path}/*.db", "images", ["image_id", "name"], 2)
    with monkeypatch.context() as m:
        m.setattr(db.Reader, "_open", lambda *a: pytest.fail("opened by the driver"))
        parts = reader.partitions()
    assert 60 <= len(parts) <= 150
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 900
    monkeypatch.setattr(db, "LARGE_BYTES", 1)
    monkeypatch.setattr(db, "PACKS", 10**9)
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == sorted(rows)
