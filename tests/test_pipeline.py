import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.functions import color
from viewgraph.operators import metrics
from viewgraph.plans import pipeline
from viewgraph.schema import CAMERA
from viewgraph.streaming import incremental


def scene(spark, n=16):
    images = spark.createDataFrame([("s", "0", i, 1, f"im {i}.jpg", [1.0, 0.0, 0.0, 0.0], [float(-i), 0.0, 2.0]) for i in range(n)], "scene string, recon string, image_id int, camera_id int, name string, qvec array<double>, tvec array<double>")
    cameras = spark.createDataFrame([(1, "PINHOLE", 64, 48, [50.0, 50.0, 32.0, 24.0])], CAMERA).selectExpr("'s' AS scene", "'0' AS recon", "*")
    seen = [("s", "0", i, i, p) for i in range(n) for p in range(10 * i, 10 * i + 40)]
    observed = spark.createDataFrame(seen, "scene string, recon string, image_id int, idx int, point3d_id long")
    return images, cameras, observed


def test_a_scene_becomes_connected_samples(spark):
    images, cameras, observed = scene(spark)
    options = pipeline.SamplingOptions(images_per_sample=8, cases=2, min_common=10, trials=16, top_k=4)
    edges = pipeline.image_graph(None, observed, images, options)
    assert edges.count() == 15 + 14 + 13
    out = pipeline.sample_scenes(edges, images, cameras, observed, None, options).collect()
    assert out and all(len(r.imgs) == 8 and r.edges for r in out)
    name, view = next(iter(out[0].imgs.items()))
    i = int(name.split("_")[1].split(".")[0])
    assert np.allclose(np.array(view.c2w)[:3, 3], [i, 0, -2]) and view.k[0][0] == 50.0
    kept = images.limit(4).select("scene", "recon", F.lit("im_0.jpg").alias("id"))
    assert pipeline.sample_scenes(edges, images, cameras, observed, kept, options).collect() == []


def test_matches_come_first(spark):
    images, _, observed = scene(spark, 3)
    matches = spark.createDataFrame([("s", "0", "im 0.jpg", "im_1.jpg", 20, 1), ("s", "0", "im 0.jpg", "gone.jpg", 50, 1)], "scene string, recon string, src string, dst string, matches_num long, loaded_at int")
    assert [tuple(r) for r in pipeline.image_graph(matches, observed, images).collect()] == [("s", "0", "im_0.jpg", "im_1.jpg", 20)]


def test_depths_are_cleaned_and_bad_ones_stop_nothing(spark):
    z = np.full((12, 12), 2, "<f4")
    prior = z * 2
    prior[3, 3] = 9
    depths = spark.createDataFrame([("a", 12, 12, z.tobytes()), ("b", 12, 12, b"bad")], "path string, h int, w int, data binary")
    classes = spark.createDataFrame([("a", np.ones((12, 12), "<i4").tobytes())], "path string, classes binary")
    priors = spark.createDataFrame([("a", prior.tobytes())], "path string, prior binary")
    out = {r.path: r.data for r in pipeline.clean_depths(depths, classes, priors).collect()}
    got = np.frombuffer(out["a"], "<f4").reshape(12, 12)
    assert out["b"] is None and (got > 0).sum() == 99 and got[3, 3] == 0


def test_clouds_are_aligned_and_measured(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(40, 3)) * 5
    frame = lambda p: spark.createDataFrame([("m", "q", i, *map(float, v)) for i, v in enumerate(p)], "model string, seq string, idx long, x double, y double, z double")
    per, macro = pipeline.evaluate_clouds(frame(x), frame(x * 2 + 1), ["model", "seq"], 0.5, 2)
    row = per.first()
    assert row.acc < 1e-6 and row.comp_ratio == 1.0 and row.nc == pytest.approx(1)
    assert macro.first().acc < 1e-6


def test_colors(spark):
    df = spark.createDataFrame([(10.0, 200.0, 30.0), (255.0, 255.0, 255.0), (0.0, 0.0, 0.0)], "r double, g double, b double")
    lab = df.select("*", *[c.alias(n) for n, c in zip(("l", "a", "bb"), color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))])
    for row in lab.select("*", *[c.alias(n) for n, c in zip("xyz", color.lab_to_rgb(F.col("l"), F.col("a"), F.col("bb")))]).collect():
        assert (row.x, row.y, row.z) == (row.r, row.g, row.b)
    px = spark.createDataFrame([("q", i, float(10 * i + k), 0.0, 0.0, True) for i in (1, 2) for k in (0, 2)] + [("q", 3, 7.0, 0.0, 0.0, False)], "seq string, image int, l double, a double, b double, ok boolean")
    out = color.matched_colors(px, ["seq"], "image").groupBy("image").agg(F.avg("l").alias("m")).collect()
    assert {r.image: round(r.m, 6) for r in out} == {1: 16.0, 2: 16.0, 3: 7.0}
    assert spark.range(1).select(F.array(*color.color_by_place(F.lit(5.0), F.lit(5.0), F.lit(10.0), F.lit(10.0)))).first()[0] == [255, 255, 255]


def test_scales_by_least_absolute_error(spark):
    rows = [("a", float(i), 3.0 * i + 1) for i in range(1, 30)] + [("a", 5.0, 500.0), ("a", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "seq string, pred double, gt double")
    fit = metrics.depth_scale(df, ["seq"], "lad", 30).first()
    assert fit.s == pytest.approx(3, abs=1e-3) and fit.t == pytest.approx(1, abs=1e-2)
    assert metrics.depth_scale(df, ["seq"], "none").first().s == 1.0
    with pytest.raises(ValueError):
        metrics.depth_scale(df, ["seq"], "other")


def test_trajectories(spark):
    def pose(x):
        return np.array([1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], float).tolist()

    rows = [("q", t, pose(float(t)), pose(t * 1.5)) for t in range(4)]
    df = spark.createDataFrame(rows, "seq string, ts int, gt array<double>, pred array<double>")
    row = metrics.trajectory_errors(df, ["seq"], "ts").first()
    assert row.rpe_t == pytest.approx(0.5) and row.rpe_r < 1e-3 and row.ate == pytest.approx(np.sqrt(np.mean([0, 0.25, 1, 2.25])))
    assert metrics.last_pose_error(df, ["seq"], "ts").first().error == pytest.approx(1.5)


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00"), (3, "2024-01-05 00:00:00")], "id int, t string").selectExpr("id", "timestamp(t) AS ts")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), rows)
    once = incremental.run_to_end(spark, incremental.deduplicated(stream, ["id"], "ts"))
    assert sorted(r.id for r in once.collect()) == [1, 2, 3]
    hours = incremental.run_to_end(spark, incremental.windowed_counts(stream, [], "ts", "1 hour", "1 minute"), "complete")
    assert sorted(r.rows for r in hours.collect()) == [1, 3]
