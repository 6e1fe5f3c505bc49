import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.functions import raster
from viewgraph.operators import filters, metrics, nearest, registration


def test_labels_are_four_connected():
    m = np.array([[1, 1, 0, 1], [0, 0, 1, 1], [1, 0, 0, 0]], bool)
    labels, n = raster.label(m)
    assert n == 3 and labels.tolist() == [[1, 1, 0, 2], [0, 0, 2, 2], [3, 0, 0, 0]]
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1, 8] = snake[3, 0] = snake[5, 8] = snake[7, 0] = True
    assert raster.label(snake)[1] == 1 and raster.label(np.zeros((2, 2), bool))[1] == 0


def test_kernels():
    z = np.full((12, 12), 2.0)
    assert np.allclose(raster.gradient(z), 0)
    step = z.copy()
    step[:, 6:] = 9
    assert (raster.cut_gradient(step)[:, 4:8] == 0).all() and (raster.cut_gradient(step)[:, :3] == 2).all()
    noisy = z.copy()
    noisy[5, 5] = 30
    assert raster.cut_unstable(noisy)[5, 5] == 0 and (raster.cut_unstable(noisy) > 0).sum() == 143
    assert raster.erode(z > 0).sum() == 100
    assert (raster.cut_small(z) > 0).sum() == 100 and (raster.cut_small(z, 101) > 0).sum() == 0
    classes = np.full((12, 12), 12)
    classes[:, 6] = 1
    half = z.copy()
    half[:8, :6] = 0
    out = raster.cut_sparse_objects(half, classes)
    assert (out[:, :6] == 0).all() and (out[:, 7:] > 0).all()
    assert (raster.cut_sky(z, np.full((12, 12), 2)) == 0).all()
    prior = z * 3
    prior[0, 0] *= 2
    kept = raster.cut_by_prior(z, prior, np.ones((12, 12), bool))
    assert kept[0, 0] == 0 and (kept > 0).sum() == 143
    assert raster.depth_edges(step, atol=1).sum() == 24


@pytest.mark.parametrize("o", range(1, 9))
def test_orientations_go_back(o):
    z = np.arange(12).reshape(3, 4)
    assert (raster.upright(raster.upright(z, o), o, back=True) == z).all()


def test_crop_resize_and_pad():
    z = np.arange(12.0).reshape(3, 4)
    assert raster.crop(z, 1, 2, 3, 3, strict=True).tolist() == [[6, 7, 0], [10, 11, 0], [0, 0, 0]]
    assert raster.crop(z, -1, -1, 2, 2, strict=True).tolist() == [[0, 0], [0, 0]]
    assert raster.resize_nearest(z, 6, 8)[::2, ::2].tolist() == z.tolist()
    assert np.allclose(raster.resize_smooth(np.full((9, 9), 5.0), 4, 13), 5)
    assert raster.square_pad(z)[1:] == (0, 0) and raster.square_pad(z)[0].shape == (4, 4)


def test_raster_udf_survives_bad_rows(spark):
    z = np.ones((4, 4), "<f4")
    df = spark.createDataFrame([(4, 4, z.tobytes()), (4, 4, b"x"), (None, 4, z.tobytes()), (4, 4, None)], "h int, w int, data binary")
    out = [r[0] for r in df.select(raster.raster_udf(lambda a: a * 2)("h", "w", "data")).collect()]
    assert np.frombuffer(out[0], "<f4").sum() == 32 and out[1:] == [None] * 3


def test_image_filters(spark):
    rows = [("Fisheye 8mm", None, None, "a.jpg", 4, 3, True), (None, 2, None, "a", 4, 3, True), (None, None, 10, "a", 4, 3, True), (None, None, 3, "a", 4, 3, True), (None, None, None, "x/Pano 1", 4, 3, True), (None, None, None, "panoramio", 4, 3, True), (None, None, None, "a", 9, 3, True), (None, None, None, "a", 12, 3, False)]
    df = spark.createDataFrame(rows, "lens string, focal int, f35 int, name string, w int, h int, exif boolean")
    fish = filters.fisheye(F.col("lens"), F.col("focal"), F.col("f35"))
    keep = filters.keep_image(F.lit(True), F.col("exif"), fish, filters.panorama(F.col("name"), F.col("w"), F.col("h")))
    assert [r[0] for r in df.select(keep).collect()] == [False, False, False, True, False, True, False, True]
    assert filters.recon_ids(" * ") is None and filters.recon_ids("0, 2,,") == ["0", "2"]


def test_accuracy_auc_and_medians(spark):
    e = np.array([0.5, 1, 2.7, 5, 9.99, 30, 30.5, 80])
    df = spark.createDataFrame([(float(x),) for x in e], "e double")
    row = df.select(metrics.accuracy(F.col("e"), 5).alias("a"), metrics.auc(F.col("e"), 30).alias("u"), metrics.lower_median("e").alias("m")).first()
    hist, _ = np.histogram(e, bins=np.arange(31))
    assert row.a == 37.5 and row.u == pytest.approx(100 * np.mean(np.cumsum(hist / len(e)))) and row.m == 5.0
    fine, _ = np.histogram(e, bins=31, range=(0, 30))
    assert df.select(metrics.auc_fine(F.col("e"), 30)).first()[0] == pytest.approx(np.mean(np.cumsum(fine / len(e))))


def test_depth_errors_of_nothing_are_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0), ("b", None, 1.0)], "seq string, pred double, gt double")
    out = {r.seq: r for r in metrics.depth_errors(df, ["seq"]).collect()}
    assert out["a"].valid == 0 and out["a"].rmse == 0.0 and out["b"].valid == 1 and out["b"].abs_rel == 1.0 and out["b"].d0 == 0.0
    nan = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    assert metrics.macro_average(nan, ["v"]).first()[0] == 1.0


def cloud(spark, p, keys="g"):
    return spark.createDataFrame([(keys, i, *map(float, x)) for i, x in enumerate(p)], "k string, idx long, x double, y double, z double")


def test_nearest_is_exact_at_any_density(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=(80, 3)), [[500, 0, 0]]])
    b = np.concatenate([rng.normal(size=(60, 3)) * 3, [[-40, 7, 9]]])
    got = {r.idx: (r.nn, r.distance) for r in nearest.nearest(cloud(spark, a), cloud(spark, b), ["k"], 0.05).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=-1)
    assert len(got) == 81 and all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(81))
    assert nearest.nearest(cloud(spark, a), cloud(spark, b, "other"), ["k"], 1.0).collect() == []


def test_asof(spark):
    a = spark.createDataFrame([("u", 1.0, "a"), ("u", 5.0, "b"), ("u", 99.0, "c"), ("u", None, "d")], "k string, ts double, n string")
    b = spark.createDataFrame([("u", 0.5), ("u", 1.5), ("u", 5.9), ("v", 5.0)], "k string, ts double")
    assert {(r.n, r.r_ts) for r in nearest.asof(a, b, ["k"], "ts", 1.0).collect()} == {("a", 0.5), ("b", 5.9)}


def turn(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, ::-1]


def test_similarity_recovers_a_motion_and_handles_reflections(spark):
    rng = np.random.default_rng(2)
    x, r, t = rng.normal(size=(50, 3)), turn(rng), rng.normal(size=3)
    y = 1.7 * x @ r.T + t
    both = np.concatenate([x, y], axis=1)
    df = spark.createDataFrame([("g", *map(float, v)) for v in both], "k string, x double, y double, z double, u double, v double, w double")
    row = registration.similarity(df, ["k"]).first()
    assert row.s == pytest.approx(1.7) and np.allclose(np.reshape(row.r, (3, 3)), r) and np.allclose(row.t, t)
    s, rr, _ = registration.fit_similarity(x, x * [1, 1, -1])
    assert np.linalg.det(rr) == pytest.approx(1) and s < 1
    s, rr, tt = registration.robust_similarity(x, 1.05 * x + 0.01)
    assert s == pytest.approx(1.05) and np.allclose(tt, 0.01)


def test_icp_brings_a_cloud_back(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(60, 3)) * 10
    moved = registration.icp(cloud(spark, x + 0.05), cloud(spark, x), ["k"], 1.0, 4)
    back = np.array([[r.x, r.y, r.z] for r in moved.orderBy("idx").collect()])
    assert np.abs(back - x).max() < 1e-6


def test_normals_and_farthest_points(spark):
    rng = np.random.default_rng(4)
    flat = np.concatenate([rng.uniform(size=(40, 2)), np.zeros((40, 1))], axis=1)
    n = registration.normals(cloud(spark, flat), ["k"], 8).collect()
    assert all(abs(r.nz) == pytest.approx(1) for r in n)
    f = registration.farthest_points(cloud(spark, flat), ["k"], 5).collect()
    assert len({r.idx for r in f}) == 5


def test_merged_chunks_agree(spark):
    rng = np.random.default_rng(5)
    x, r = rng.normal(size=(4, 5, 3)), turn(rng)
    rows = [("q", c, f, p, *map(float, x[f, p] if c == 0 else 2 * r @ x[f, p] + 1)) for c, fs in ((0, (0, 1)), (1, (1, 2, 3))) for f in fs for p in range(5)]
    df = spark.createDataFrame(rows, "k string, chunk int, frame int, pix long, x double, y double, z double")
    out = registration.merge_chunks(df, ["k"]).collect()
    assert len(out) == 20 and all(np.allclose([o.x, o.y, o.z], x[o.frame, o.pix]) for o in out)
    assert {o.votes for o in out if o.frame == 1} == {2}
