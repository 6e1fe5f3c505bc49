import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.functions import geometry as g


def one(spark, **columns):
    df = spark.range(1)
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(v):
    return F.array(*[F.lit(float(x)) for x in np.ravel(v)])


def quat(rng):
    q = rng.normal(size=4)
    return q / np.linalg.norm(q)


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_quaternions_go_round(spark):
    rng = np.random.default_rng(1)
    qs = [*[quat(rng) for _ in range(6)], np.array([0.0, 1, 0, 0]), np.array([0.0, 0, 0, 1])]
    df = spark.createDataFrame([(q.tolist(), [*q[1:].tolist(), float(q[0])]) for q in qs], "wxyz array<double>, xyzw array<double>")
    df = df.withColumns({"r": g.quat_wxyz_to_matrix(F.col("wxyz")), "s": g.quat_xyzw_to_matrix(F.col("xyzw"))}).withColumn("back", g.matrix_to_quat_xyzw(F.col("s")))
    for row in df.collect():
        q = np.array(row.wxyz)
        assert np.allclose(row.r, matrix(q).ravel()) and np.allclose(row.s, row.r)
        want = np.array([*q[1:], q[0]]) * (-1 if q[0] < 0 else 1)
        assert np.allclose(np.abs(np.dot(row.back, want)), 1)


def test_rigid_transforms(spark):
    rng = np.random.default_rng(2)
    a, b = (np.block([[matrix(quat(rng)), rng.normal(size=(3, 1))], [0, 0, 0, 1]]) for _ in range(2))
    p = rng.normal(size=3)
    row = one(spark, inv=g.rigid_inverse(lit(a)), rel=g.relative_pose(lit(a), lit(b)), c=g.camera_center(lit(a)), p=g.transform_point(lit(a), lit(p)), det=g.determinant(g.rotation_of(lit(a))))
    assert np.allclose(row.inv, np.linalg.inv(a).ravel())
    assert np.allclose(row.rel, (b @ np.linalg.inv(a)).ravel())
    assert np.allclose(row.c, np.linalg.inv(a)[:3, 3])
    assert np.allclose(row.p, a[:3, :3] @ p + a[:3, 3])
    assert row.det == pytest.approx(1)


def test_nulls_give_nulls(spark):
    null = F.lit(None).cast("array<double>")
    row = one(spark, a=g.quat_wxyz_to_matrix(null), b=g.rigid_inverse(null), c=g.matrix_to_quat_xyzw(null), d=g.intrinsics(F.lit("OPENCV"), lit([1, 2, 3, 4])), e=g.oriented_intrinsics(null, F.lit(1), F.lit(1), F.lit(1)))
    assert list(row) == [None] * 5


def test_errors_in_degrees(spark):
    turn = matrix([np.cos(np.radians(5)), 0, 0, np.sin(np.radians(5))])  # 10 degrees about z
    eye = np.eye(3)
    row = one(spark, r=g.rotation_error(lit(eye), lit(turn)), same=g.rotation_error(lit(eye), lit(eye)), t=g.translation_error(lit([1, 0, 0]), lit([0, 1, 0])), back=g.translation_error(lit([1, 0, 0]), lit([-2, 0, 0])), zero=g.translation_error(lit([1, 0, 0]), lit([0, 0, 0])))
    assert row.r == pytest.approx(10) and row.same < 1e-5 and row.t == pytest.approx(90) and row.back < 1e-5 and row.zero == pytest.approx(90)


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation_moves_the_principal_point_with_the_image(spark, o):
    k = [[100, 0, 30], [0, 120, 20], [0, 0, 1]]
    row = one(spark, k=g.oriented_intrinsics(lit(k), F.lit(64), F.lit(48), F.lit(o)))
    cx, cy = {1: (30, 20), 2: (34, 20), 3: (34, 28), 4: (30, 28), 5: (20, 30), 6: (28, 30), 7: (28, 34), 8: (20, 34)}[o]
    assert (row.k[2], row.k[5]) == (cx, cy) and (row.k[0], row.k[4]) == ((100, 120) if o < 5 else (120, 100))


def test_unproject_then_project(spark):
    rng = np.random.default_rng(3)
    pose = np.block([[matrix(quat(rng)), rng.normal(size=(3, 1))], [0, 0, 0, 1]])
    k = [[100, 0, 30], [0, 120, 20], [0, 0, 1]]
    world = F.array(*g.unproject_world(lit(k), lit(pose), F.lit(11.0), F.lit(7.0), F.lit(2.5)))
    row = one(spark, uvz=F.array(*g.project(lit(k), lit(pose), world)))
    assert np.allclose(row.uvz, [11, 7, 2.5])


def test_turns_resizes_and_codes(spark):
    k = [[100, 0, 30], [0, 120, 20], [0, 0, 1]]
    pose = np.eye(4)
    df = spark.createDataFrame([(pose.ravel().tolist(), np.ravel(k).astype(float).tolist())], "m array<double>, k array<double>")
    p, kk = g.decode_pose(F.col("code"), F.lit(60.0), F.lit(40.0))
    coded = df.withColumn("code", g.encode_pose(F.col("m"), F.col("k"), F.lit(60.0), F.lit(40.0))).select(p.alias("p"), kk.alias("k")).first()
    row = one(spark, t=g.quarter_turn_intrinsics(lit(k), F.lit(64.0), F.lit(48.0), F.lit(True)), e=g.quarter_turn_extrinsics(lit(pose), F.lit(True)), r=g.resized_intrinsics(lit(k), F.lit(2.0)), size=g.target_size(F.lit(519), 14), d=g.inverse_depth(g.inverse_depth(F.lit(4.0))), zero=g.inverse_depth(F.lit(0.0)))
    assert row.t == [120, 0, 28, 0, 100, 30, 0, 0, 1]
    assert row.e[:3] == [0, -1, 0]
    assert row.r[2] == 60.5 and row.r[0] == 200
    assert np.allclose(coded.p, pose.ravel()) and np.allclose(coded.k, [100, 0, 30, 0, 120, 20, 0, 0, 1])
    assert row.size == 518 and row.d == 4.0 and row.zero == 0.0
