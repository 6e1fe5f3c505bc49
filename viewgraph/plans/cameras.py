"""Queries on camera geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import filters
from ..operators import metrics as mt
from ..session import table

KEYS = ["scene", "recon"]


def _spread(prefix: str, m: Column, n: int, digits: int = 6) -> list[Column]:
    return [F.round(g.at(m, i), digits).alias(f"{prefix}{i}") for i in range(n)]


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image").select(*KEYS, "image_id", "camera_id", "name", "qvec", "tvec").distinct()


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).withColumn("w2c", g.rigid(g.quat_wxyz_to_matrix(F.col("qvec")), F.col("tvec")))


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "camera").select(*KEYS, "camera_id", "model", "width", "height", "params").distinct()


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.quat_wxyz_to_matrix(F.col("qvec"))
    return _images(spark, sf_dir).select(*KEYS, "image_id", *_spread("r", m, 9, 9))


def quaternions_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternion to matrix to quaternion: the same rotation with w >= 0, up to its length."""
    q = F.col("qvec")
    rows = _images(spark, sf_dir).withColumn("r", g.quat_xyzw_to_matrix(F.array(g.at(q, 1), g.at(q, 2), g.at(q, 3), g.at(q, 0))))
    back = g.matrix_to_quat_xyzw(F.col("r"))
    return rows.select(*KEYS, "image_id", *_spread("q", back, 4, 5))


def rigid_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posed(spark, sf_dir).select(*KEYS, "image_id", *_spread("m", g.rigid_inverse(F.col("w2c")), 12, 8))


def image_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the size and model of their camera."""
    return _images(spark, sf_dir).join(_cameras(spark, sf_dir), [*KEYS, "camera_id"]).select(*KEYS, "image_id", "camera_id", "model", "width", "height")


def intrinsic_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics of pinhole cameras; other models have none."""
    k = g.intrinsics(F.col("model"), F.col("params"))
    return _cameras(spark, sf_dir).where(k.isNotNull()).select(*KEYS, "camera_id", *_spread("k", k, 9))


def oriented_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics under all eight orientations."""
    k = g.intrinsics(F.col("model"), F.col("params"))
    rows = _cameras(spark, sf_dir).where(k.isNotNull() & F.col("width").isNotNull()).withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(8))))
    out = g.oriented_intrinsics(k, F.col("width"), F.col("height"), F.col("o"))
    return rows.select(*KEYS, "camera_id", "o", *[F.round(g.at(out, i), 6).alias(f"k{i}") for i in (0, 2, 4, 5)])


def resized_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics for a target of 518 pixels: resized to cover it, and moved to pixel centres."""
    k = g.intrinsics(F.col("model"), F.col("params"))
    rows = _cameras(spark, sf_dir).where(k.isNotNull() & F.col("width").isNotNull())
    rows = rows.withColumn("s", g.resize_scale(F.col("width"), F.col("height"), F.lit(518), F.lit(518)))
    out = g.centered_intrinsics(g.resized_intrinsics(k, F.col("s")))
    size = [g.target_size(F.floor(F.col(c) * F.col("s")), 14).alias(c) for c in ("width", "height")]
    return rows.select(*KEYS, "camera_id", *[F.round(g.at(out, i), 6).alias(f"k{i}") for i in (0, 2, 4, 5)], *size)


def unprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World points of the first observations of each image, at a depth of 2."""
    k = g.intrinsics(F.col("model"), F.col("params"))
    cams = _cameras(spark, sf_dir).withColumn("k", k).where("k is not null").select(*KEYS, "camera_id", "k")
    poses = _posed(spark, sf_dir)
    seen = table(spark, sf_dir, "observation").where("x is not null and y is not null").select(*KEYS, "image_id", "idx", "x", "y").distinct()
    rows = seen.join(poses.select(*KEYS, "image_id", "camera_id", "w2c"), [*KEYS, "image_id"]).join(cams, [*KEYS, "camera_id"])
    p = g.unproject_world(F.col("k"), F.col("w2c"), F.col("x"), F.col("y"), F.lit(2.0))
    return rows.select(*KEYS, "image_id", "idx", *[F.round(v, 6).alias(n) for v, n in zip(p, "xyz")])


def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean depth and share of points in front of the camera, for each image's own points."""
    points = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz").distinct()
    seen = table(spark, sf_dir, "observation").where("point3d_id >= 0").select(*KEYS, "image_id", "point3d_id").distinct()
    rows = seen.join(points, [*KEYS, "point3d_id"]).join(_posed(spark, sf_dir), [*KEYS, "image_id"])
    z = g.at(g.transform_point(F.col("w2c"), F.col("xyz")), 2)
    return rows.groupBy(*KEYS, "image_id").agg(F.round(F.avg(z), 6).alias("mean_z"), F.round(F.avg(g.valid_depth(z).cast("double")), 6).alias("in_front"))


def _pose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative pose errors where the prediction of an image is its pose with a slightly turned quaternion."""
    q = F.col("qvec")
    turned = F.array(g.at(q, 0) + 0.02, g.at(q, 1), g.at(q, 2) - 0.01, g.at(q, 3))
    turned = F.array(g.at(turned, 1), g.at(turned, 2), g.at(turned, 3), g.at(turned, 0))
    moved = F.array(*[g.at(F.col("tvec"), i) * f for i, f in enumerate((1.0, 1.05, 0.95))])
    gt = g.rigid(g.quat_xyzw_to_matrix(F.array(g.at(q, 1), g.at(q, 2), g.at(q, 3), g.at(q, 0))), F.col("tvec"))
    poses = _images(spark, sf_dir).select(*KEYS, F.col("image_id").alias("frame"), gt.alias("gt"), g.rigid(g.quat_xyzw_to_matrix(turned), moved).alias("pred"))
    return mt.pose_pairs(poses, KEYS)


def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pose_pairs(spark, sf_dir)
    return pairs.select(*KEYS, "i", "j", F.round("r_error", 3).alias("r_error"), F.round("t_error", 3).alias("t_error"))


def pose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies and AUC of each reconstruction over its pairs."""
    out = mt.pose_summary(_pose_pairs(spark, sf_dir), KEYS)
    return out.select(*KEYS, *[F.round(c, 3).alias(c) for c in out.columns if c not in KEYS])


def pose_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the field of view and focal lengths of pinhole images."""
    k = g.intrinsics(F.col("model"), F.col("params"))
    cams = _cameras(spark, sf_dir).withColumn("k", k).where("k is not null and width is not null")
    rows = _posed(spark, sf_dir).join(cams, [*KEYS, "camera_id"])
    rows = rows.withColumn("code", g.encode_pose(F.col("w2c"), F.col("k"), F.col("width"), F.col("height")))
    code = F.col("code")
    _, back = g.decode_pose(code, F.col("width"), F.col("height"))
    return rows.select(*KEYS, "image_id", F.round(g.at(code, 7), 6).alias("fov_h"), F.round(g.at(code, 8), 6).alias("fov_w"), F.round(g.at(back, 0), 4).alias("fx"), F.round(g.at(back, 4), 4).alias("fy"))


def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are kept, by the camera's model as lens, its size, and name; images without a camera are unreadable."""
    rows = _images(spark, sf_dir).join(_cameras(spark, sf_dir), [*KEYS, "camera_id"], "left")
    focal = F.get("params", F.lit(0)).cast("int")
    fish = filters.fisheye(F.col("model"), F.lit(None).cast("int"), (focal / 100).cast("int"))
    keep = filters.keep_image(F.col("model").isNotNull(), F.col("width").isNotNull(), fish, filters.panorama(F.col("name"), F.col("width"), F.col("height")))
    return rows.select(*KEYS, "image_id", "camera_id", "model", "width", keep.alias("keep")).distinct()


_FUNCTIONS = (rotations, quaternions_back, rigid_inverses, image_cameras, intrinsic_matrices, oriented_intrinsics, resized_intrinsics, unprojected, reprojection, pose_errors, pose_summary, pose_codes, image_filter)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _rot(w: str, x: str, y: str, z: str) -> list[str]:
    """A unit quaternion's matrix in SQL."""
    return [f"1-2*({y}*{y}+{z}*{z})", f"2*({x}*{y}-{w}*{z})", f"2*({z}*{x}+{w}*{y})", f"2*({x}*{y}+{w}*{z})", f"1-2*({x}*{x}+{z}*{z})", f"2*({y}*{z}-{w}*{x})", f"2*({z}*{x}-{w}*{y})", f"2*({y}*{z}+{w}*{x})", f"1-2*({x}*{x}+{y}*{y})"]


_UNIT = _rot("qvec[1]", "qvec[2]", "qvec[3]", "qvec[4]")
_R = ", ".join(f"{e} AS r{i}" for i, e in enumerate(_UNIT))
_IMG = "img AS (SELECT DISTINCT scene, recon, image_id, camera_id, name, qvec, tvec FROM image)"
_CAM = "cam AS (SELECT DISTINCT scene, recon, camera_id, model, width, height, params FROM camera)"
_POSE = f"{_IMG}, pose AS (SELECT scene, recon, image_id, camera_id, tvec[1] AS t0, tvec[2] AS t1, tvec[3] AS t2, {_R} FROM img)"
_K = f"""{_CAM}, k AS (SELECT *, CASE model WHEN 'SIMPLE_PINHOLE' THEN params[1] WHEN 'PINHOLE' THEN params[1] END AS fx,
    CASE model WHEN 'SIMPLE_PINHOLE' THEN params[1] WHEN 'PINHOLE' THEN params[2] END AS fy,
    CASE model WHEN 'SIMPLE_PINHOLE' THEN params[2] WHEN 'PINHOLE' THEN params[3] END AS cx,
    CASE model WHEN 'SIMPLE_PINHOLE' THEN params[3] WHEN 'PINHOLE' THEN params[4] END AS cy FROM cam WHERE model IN ('SIMPLE_PINHOLE', 'PINHOLE'))"""
_LEN = "(x*x+y*y+z*z+w*w)"


def _scaled(w: str, x: str, y: str, z: str) -> list[str]:
    """Any quaternion's matrix in SQL."""
    n = f"(2/({x}*{x}+{y}*{y}+{z}*{z}+{w}*{w}))"
    return [f"1-{n}*({y}*{y}+{z}*{z})", f"{n}*({x}*{y}-{z}*{w})", f"{n}*({x}*{z}+{y}*{w})", f"{n}*({x}*{y}+{z}*{w})", f"1-{n}*({x}*{x}+{z}*{z})", f"{n}*({y}*{z}-{x}*{w})", f"{n}*({x}*{z}-{y}*{w})", f"{n}*({y}*{z}+{x}*{w})", f"1-{n}*({x}*{x}+{y}*{y})"]


def _pairs_sql() -> str:
    gt = _scaled("qvec[1]", "qvec[2]", "qvec[3]", "qvec[4]")
    pred = _scaled("(qvec[1]+0.02)", "qvec[2]", "(qvec[3]-0.01)", "qvec[4]")
    cols = [f"{e} AS g{i}" for i, e in enumerate(gt)] + [f"{e} AS p{i}" for i, e in enumerate(pred)]
    cols += ["tvec[1] AS gt0", "tvec[2] AS gt1", "tvec[3] AS gt2", "tvec[1]*1.0 AS pt0", "tvec[2]*1.05 AS pt1", "tvec[3]*0.95 AS pt2"]
    rel = []
    for s in "gp":
        for r in range(3):
            row = [" + ".join(f"b.{s}{3 * r + k}*a.{s}{3 * c + k}" for k in range(3)) for c in range(3)]
            rel += [f"{e} AS {s}r{3 * r + c}" for c, e in enumerate(row)]
            # t_j - R_j R_i^T t_i
            rel.append(f"b.{s}t{r} - ({' + '.join(f'({row[c]})*a.{s}t{c}' for c in range(3))}) AS {s}v{r}")
    trace = " + ".join(f"gr{i}*pr{i}" for i in range(9))
    gn, pn = (f"(sqrt({' + '.join(f'{s}v{i}*{s}v{i}' for i in range(3))}) + 1e-15)" for s in "gp")
    cosine = " + ".join(f"gv{i}/{gn}*pv{i}/{pn}" for i in range(3))
    return f"""
        WITH {_IMG}, f AS (SELECT scene, recon, image_id, {', '.join(cols)} FROM img),
        rel AS (SELECT a.scene, a.recon, a.image_id AS i, b.image_id AS j, {', '.join(rel)} FROM f a JOIN f b USING (scene, recon) WHERE a.image_id < b.image_id),
        err AS (SELECT scene, recon, i, j, degrees(acos(greatest(-1, least(1, ({trace} - 1) / 2)))) AS r_error,
            degrees(acos(sqrt(1 - greatest(1 - ({cosine})*({cosine}), 1e-15)))) AS t_error FROM rel)"""


def _summary_sql() -> str:
    out = []
    for t in mt.THRESHOLDS:
        out += [f"round(avg(CASE WHEN r_error < {t} THEN 100.0 ELSE 0 END), 3) AS racc_{t}", f"round(avg(CASE WHEN t_error < {t} THEN 100.0 ELSE 0 END), 3) AS tacc_{t}"]
        e = "greatest(r_error, t_error)"
        out.append(f"round(100 * avg(CASE WHEN {e} <= {t} THEN ({t} - least(floor({e}), {t - 1})) / {t} ELSE 0 END), 3) AS auc_{t}")
    for c in ("r_error", "t_error"):
        out += [f"round(avg({c}), 3) AS mean_{c}", f"round(quantile_cont({c}, 0.5), 3) AS median_{c}"]
    return _pairs_sql() + f" SELECT scene, recon, {', '.join(out)} FROM err GROUP BY ALL"


_ORIENTED = {1: ("fx", "fy", "cx", "cy"), 2: ("fx", "fy", "width-cx", "cy"), 3: ("fx", "fy", "width-cx", "height-cy"), 4: ("fx", "fy", "cx", "height-cy"), 5: ("fy", "fx", "cy", "cx"), 6: ("fy", "fx", "height-cy", "cx"), 7: ("fy", "fx", "height-cy", "width-cx"), 8: ("fy", "fx", "cy", "width-cx")}

SQL = {
    "rotations": f"WITH {_POSE} SELECT scene, recon, image_id, {', '.join(f'round(r{i}, 9) AS r{i}' for i in range(9))} FROM pose",
    "quaternions_back": f"""
        WITH {_IMG}, q AS (SELECT scene, recon, image_id, qvec[1] AS w, qvec[2] AS x, qvec[3] AS y, qvec[4] AS z FROM img),
        n AS (SELECT *, sqrt({_LEN}) * (CASE WHEN w < 0 THEN -1 ELSE 1 END) AS l FROM q)
        SELECT scene, recon, image_id, round(x/l, 5) AS q0, round(y/l, 5) AS q1, round(z/l, 5) AS q2, round(w/l, 5) AS q3 FROM n""",
    "rigid_inverses": f"WITH {_POSE} SELECT scene, recon, image_id, "
    + ", ".join(f"round(r{3 * c + r}, 8) AS m{4 * r + c}" for r in range(3) for c in range(3))
    + ", " + ", ".join(f"round(-({' + '.join(f'r{3 * k + r}*t{k}' for k in range(3))}), 8) AS m{4 * r + 3}" for r in range(3)) + " FROM pose",
    "image_cameras": f"WITH {_IMG}, {_CAM} SELECT scene, recon, image_id, camera_id, model, width, height FROM img JOIN cam USING (scene, recon, camera_id)",
    "intrinsic_matrices": f"WITH {_K} SELECT scene, recon, camera_id, round(fx, 6) AS k0, 0.0::DOUBLE AS k1, round(cx, 6) AS k2, 0.0::DOUBLE AS k3, round(fy, 6) AS k4, round(cy, 6) AS k5, 0.0::DOUBLE AS k6, 0.0::DOUBLE AS k7, 1.0::DOUBLE AS k8 FROM k",
    "oriented_intrinsics": f"WITH {_K} " + " UNION ALL ".join(
        f"SELECT scene, recon, camera_id, {o} AS o, round(({v[0]})::DOUBLE, 6) AS k0, round(({v[2]})::DOUBLE, 6) AS k2, round(({v[1]})::DOUBLE, 6) AS k4, round(({v[3]})::DOUBLE, 6) AS k5 FROM k WHERE width IS NOT NULL"
        for o, v in _ORIENTED.items()),
    "resized_intrinsics": f"""
        WITH {_K}, s AS (SELECT *, greatest(522.0::DOUBLE / width, 522.0::DOUBLE / height) AS s FROM k WHERE width IS NOT NULL)
        SELECT scene, recon, camera_id, round(fx*s, 6) AS k0, round((cx+0.5)*s - 0.5 - 0.5, 6) AS k2, round(fy*s, 6) AS k4, round((cy+0.5)*s - 0.5 - 0.5, 6) AS k5,
        (floor(floor(width*s)/14)*14)::INT AS width, (floor(floor(height*s)/14)*14)::INT AS height FROM s""",
    "unprojected": f"""
        WITH {_K}, {_POSE}, o AS (SELECT DISTINCT scene, recon, image_id, idx, x, y FROM observation WHERE x IS NOT NULL AND y IS NOT NULL),
        c AS (SELECT o.scene, o.recon, o.image_id, idx, (x-cx)*2.0/fx - t0 AS dx, (y-cy)*2.0/fy - t1 AS dy, 2.0 - t2 AS dz, r0,r1,r2,r3,r4,r5,r6,r7,r8
              FROM o JOIN pose USING (scene, recon, image_id) JOIN k USING (scene, recon, camera_id))
        SELECT scene, recon, image_id, idx, round(r0*dx+r3*dy+r6*dz, 6) AS x, round(r1*dx+r4*dy+r7*dz, 6) AS y, round(r2*dx+r5*dy+r8*dz, 6) AS z FROM c""",
    "reprojection": f"""
        WITH {_POSE}, o AS (SELECT DISTINCT scene, recon, image_id, point3d_id FROM observation WHERE point3d_id >= 0),
        p AS (SELECT DISTINCT scene, recon, point3d_id, xyz FROM point3d),
        z AS (SELECT scene, recon, image_id, r6*xyz[1] + r7*xyz[2] + r8*xyz[3] + t2 AS z FROM o JOIN p USING (scene, recon, point3d_id) JOIN pose USING (scene, recon, image_id))
        SELECT scene, recon, image_id, round(avg(z), 6) AS mean_z, round(avg((z > 1e-8)::INT), 6) AS in_front FROM z GROUP BY ALL""",
    "pose_errors": _pairs_sql() + " SELECT scene, recon, i, j, round(r_error, 3) AS r_error, round(t_error, 3) AS t_error FROM err",
    "pose_summary": _summary_sql(),
    "pose_codes": f"""
        WITH {_IMG}, {_K} SELECT scene, recon, image_id, round(2*atan(height/2.0/fy), 6) AS fov_h, round(2*atan(width/2.0/fx), 6) AS fov_w, round(fx, 4) AS fx, round(fy, 4) AS fy
        FROM img JOIN k USING (scene, recon, camera_id) WHERE width IS NOT NULL""",
    "image_filter": f"""
        WITH {_IMG}, {_CAM}, j AS (SELECT scene, recon, image_id, img.camera_id, name, model, width, height, trunc(trunc(params[1]) / 100) AS f35 FROM img LEFT JOIN cam USING (scene, recon, camera_id))
        SELECT DISTINCT scene, recon, image_id, camera_id, model, width, CASE WHEN model IS NULL THEN false WHEN width IS NULL THEN true ELSE
            NOT (lower(model) LIKE '%fisheye%' OR (f35 > 0 AND f35 <= 10 AND f35 NOT IN (3, 4, 5)))
            AND NOT (greatest(width, height) / least(width, height) >= 3
                OR (lower(regexp_extract(name, '[^/]*$')) LIKE '%pano%' AND lower(regexp_extract(name, '[^/]*$')) NOT LIKE '%panoramio%')) END AS keep
        FROM j""",
}
