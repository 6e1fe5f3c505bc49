"""Queries on views as a loader prepares them, and on trajectories.

Views are the 64 values of an embedding as rasters of 4 x 16, with intrinsics and an orientation that follow from its id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import metrics as mt
from ..operators import views as vw
from ..session import table

KEYS = ["scene", "recon"]


def _float_bytes(e: pd.Series) -> pd.Series:
    return e.map(lambda a: np.asarray(a, "<f4").tobytes())


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    k = F.array(F.lit(10.0), F.lit(0.0), (5 + i % 7).cast("double"), F.lit(0.0), F.lit(10.0), (1 + i % 2).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select("vec_id", F.lit(4).alias("h"), F.lit(16).alias("w"), k.alias("k"), F.pandas_udf(_float_bytes, "binary")("embedding").alias("data"))


def _placed(data: pd.Series) -> pd.Series:
    """A sum that tells where each value lies."""
    return pd.Series([None if d is None else float((np.frombuffer(d, "<f4").astype(float) * (1 + np.arange(len(d) // 4))).sum()) for d in data], dtype=object)


def _seen(views: DataFrame) -> DataFrame:
    k = lambda i: F.round(g.at(F.col("k"), i), 6)
    return views.select("vec_id", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), F.round(F.pandas_udf(_placed, "double")("data"), 3).alias("placed"), k(2).alias("cx"), k(5).alias("cy"), k(0).alias("fx"))


def views_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(vw.upright(_views(spark, sf_dir), F.col("vec_id") % 8 + 1))


def views_put_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright and back again."""
    o = F.col("vec_id") % 8 + 1
    back = vw.upright(vw.upright(_views(spark, sf_dir), o), o, back=True)
    return _seen(back).select("vec_id", "h", "w", "placed")


def views_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut about the principal point to 4 x 12."""
    return _seen(vw.cropped(_views(spark, sf_dir), F.lit(4), F.lit(12)))


def views_cropped_strictly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(vw.cropped(_views(spark, sf_dir), F.lit(4), F.lit(12), strict=True))


def views_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resized to cover 8 x 20 and 4 pixels: by three."""
    return _seen(vw.resized(_views(spark, sf_dir), F.lit(8), F.lit(20)))


def views_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(vw.turned(_views(spark, sf_dir), F.col("vec_id") % 2 == 0))


def views_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(vw.padded(_views(spark, sf_dir)))


def views_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain to 6 x 6: all come out in this size, with the principal point in the middle."""
    out = _seen(vw.prepared(_views(spark, sf_dir), 6, 6))
    return out.select("vec_id", "h", "w", F.col("placed").isNotNull().alias("whole"), (F.abs(F.col("cx") - 3) <= 1).alias("centered"))


# Trajectories: the images of a reconstruction in the order of their ids; a prediction is a little larger, shifted and turned.


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "image").where("qvec is not null and tvec is not null").select(*KEYS, "image_id", "qvec", "tvec").distinct()
    gt = g.rigid_inverse(g.rigid(g.quat_wxyz_to_matrix(F.col("qvec")), F.col("tvec")))
    off = F.transform(F.array(F.lit(0.01), F.lit(-0.02), F.lit(0.03)), lambda x: x * (F.col("image_id") % 5))
    rows = images.groupBy(*KEYS, "image_id").agg(F.min(F.struct("qvec", "tvec")).alias("p")).select(*KEYS, "image_id", "p.*").withColumn("gt", gt)
    c, s = float(np.cos(0.1)), float(np.sin(0.1))
    turn = F.array(*[F.lit(x) for x in (c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0)])
    pred = g.rigid(g.multiply(g.rotation_of(F.col("gt")), turn), F.zip_with(g.translation_of(F.col("gt")), off, lambda a, b: a * 1.05 + b))
    return rows.select(*KEYS, "image_id", "gt", pred.alias("pred"))


def trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of positions and of motions between neighbouring images."""
    out = mt.trajectory_errors(_moved(spark, sf_dir), KEYS, "image_id")
    return out.select(*KEYS, *[F.round(c, 5).alias(c) for c in ("ate", "rpe_t", "rpe_r")], "n")


def last_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.last_pose_error(_moved(spark, sf_dir), KEYS, "image_id").select(*KEYS, F.round("error", 5).alias("error"))


def trajectory_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions less their mean of the reconstruction."""
    from pyspark.sql.window import Window

    p = g.translation_of(F.col("gt"))
    rows = _moved(spark, sf_dir).select(*KEYS, "image_id", *[g.at(p, i).alias(c) for i, c in enumerate("xyz")])
    w = Window.partitionBy(*KEYS)
    return rows.select(*KEYS, "image_id", *[F.round(F.col(c) - F.avg(c).over(w), 5).alias(c) for c in "xyz"])


_FUNCTIONS = (
    views_upright, views_put_back, views_cropped, views_cropped_strictly, views_resized, views_turned, views_padded, views_prepared,
    trajectory_errors, last_pose_errors, trajectory_centered,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = """px AS (SELECT vec_id, ((i - 1) // 16)::INT AS v, ((i - 1) % 16)::INT AS u, embedding[i]::DOUBLE AS z, (vec_id % 8 + 1)::INT AS o, (5 + vec_id % 7)::DOUBLE AS cx, (1 + vec_id % 2)::DOUBLE AS cy
        FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE len(embedding) = 64)"""


def _placed_sql(of: str, extra: str = "round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(f), 6)::DOUBLE AS fx") -> str:
    """of: vec_id, v, u (new places), z, h, w and the intrinsics."""
    return f"SELECT vec_id, any_value(h)::BIGINT AS h, any_value(w)::BIGINT AS w, round(sum(z * (1 + v*w + u)), 3) AS placed{', ' + extra if extra else ''} FROM ({of}) GROUP BY vec_id"


_UP = """SELECT vec_id, z, 10.0 AS f, CASE WHEN o >= 5 THEN 16 ELSE 4 END AS h, CASE WHEN o >= 5 THEN 4 ELSE 16 END AS w,
    CASE o WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN 3 - v WHEN 4 THEN 3 - v WHEN 5 THEN u WHEN 6 THEN u WHEN 7 THEN 15 - u ELSE 15 - u END AS v,
    CASE o WHEN 1 THEN u WHEN 2 THEN 15 - u WHEN 3 THEN 15 - u WHEN 4 THEN u WHEN 5 THEN v WHEN 6 THEN 3 - v WHEN 7 THEN 3 - v ELSE v END AS u,
    CASE o WHEN 1 THEN cx WHEN 2 THEN 16 - cx WHEN 3 THEN 16 - cx WHEN 4 THEN cx WHEN 5 THEN cy WHEN 6 THEN 4 - cy WHEN 7 THEN 4 - cy ELSE cy END AS cx,
    CASE o WHEN 1 THEN cy WHEN 2 THEN cy WHEN 3 THEN 4 - cy WHEN 4 THEN 4 - cy WHEN 5 THEN cx WHEN 6 THEN cx WHEN 7 THEN 16 - cx ELSE 16 - cx END AS cy FROM px"""
_BOX = "b AS (SELECT *, least(2, cy, 4 - cy)::INT AS a, least(6, cx, 16 - cx)::INT AS e, least(2, cy)::INT AS sa, least(6, cx)::INT AS se FROM px)"


def _motion_sql() -> str:
    """Poses as rows of 3 x 4: camera to world of images, and the prediction."""
    q = lambda *m: "[" + ", ".join(m) + "]"
    r = q("1-2*(y*y+z*z)", "2*(x*y+w*z)", "2*(z*x-w*y)", "2*(x*y-w*z)", "1-2*(x*x+z*z)", "2*(y*z+w*x)", "2*(z*x+w*y)", "2*(y*z-w*x)", "1-2*(x*x+y*y)")
    c, s = float(np.cos(0.1)), float(np.sin(0.1))
    turned = q(*[f"r[{3 * i + 1}]*{a!r} + r[{3 * i + 2}]*{b!r}" if j < 2 else f"r[{3 * i + 3}]" for i in range(3) for j, (a, b) in enumerate(((c, s), (-s, c), (0, 0)))])
    centre = q(*[f"-(r[{3 * i + 1}]*tvec[1] + r[{3 * i + 2}]*tvec[2] + r[{3 * i + 3}]*tvec[3])" for i in range(3)])
    return f"""
        i AS (SELECT scene, recon, image_id, min({{'qvec': qvec, 'tvec': tvec}}) AS p FROM image WHERE qvec IS NOT NULL AND tvec IS NOT NULL GROUP BY ALL),
        m AS (SELECT scene, recon, image_id, p.tvec AS tvec, {r} AS r FROM (SELECT *, p.qvec[1] AS w, p.qvec[2] AS x, p.qvec[3] AS y, p.qvec[4] AS z FROM i)),
        g AS (SELECT scene, recon, image_id, r AS gr, {centre} AS gt, {turned} AS pr FROM m),
        pose AS (SELECT *, [gt[1]*1.05 + 0.01*(image_id % 5), gt[2]*1.05 - 0.02*(image_id % 5), gt[3]*1.05 + 0.03*(image_id % 5)] AS pt FROM g)"""


def _relative(a: str, b: str, at: str, bt: str) -> tuple[list[str], list[str]]:
    """Rotation and translation of the inverse of (a, at) times (b, bt)."""
    r = [" + ".join(f"{a}[{3 * k + i + 1}]*{b}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)]
    t = [" + ".join(f"{a}[{3 * k + i + 1}]*({bt}[{k + 1}] - {at}[{k + 1}])" for k in range(3)) for i in range(3)]
    return r, t


def _rpe_sql() -> str:
    lists = lambda parts: "[" + ", ".join(parts) + "]"
    gr, gt = _relative("l.gr", "p.gr", "l.gt", "p.gt")
    pr, pt = _relative("l.pr", "p.pr", "l.pt", "p.pt")
    er, et = _relative("a", "b", "ta", "tb")
    return f"""
        WITH {_motion_sql()},
        n AS (SELECT *, row_number() OVER (PARTITION BY scene, recon ORDER BY image_id) AS k FROM pose),
        d AS (SELECT p.scene, p.recon, {lists(gr)} AS a, {lists(gt)} AS ta, {lists(pr)} AS b, {lists(pt)} AS tb FROM n p JOIN n l ON l.scene = p.scene AND l.recon = p.recon AND l.k = p.k - 1),
        e AS (SELECT scene, recon, sqrt({" + ".join(f"({t})*({t})" for t in et)}) AS s, degrees(acos(greatest(-1, least(1, ({er[0]} + {er[4]} + {er[8]} - 1) / 2)))) AS r FROM d),
        x AS (SELECT scene, recon, sqrt(avg(s*s)) AS rpe_t, sqrt(avg(r*r)) AS rpe_r FROM e GROUP BY ALL),
        y AS (SELECT scene, recon, sqrt(avg(power(gt[1]-pt[1], 2) + power(gt[2]-pt[2], 2) + power(gt[3]-pt[3], 2))) AS ate, count(*) AS n FROM pose GROUP BY ALL)
        SELECT y.scene, y.recon, round(ate, 5) AS ate, round(rpe_t, 5) AS rpe_t, round(rpe_r, 5) AS rpe_r, n FROM y LEFT JOIN x USING (scene, recon)"""


def _last_sql() -> str:
    # first gt times the inverse of first pred, applied to the last predicted position
    inner = [" + ".join(f"f.pr[{3 * k + i + 1}]*(l.pt[{k + 1}] - f.pt[{k + 1}])" for k in range(3)) for i in range(3)]
    outer = [" + ".join(f"gr[{3 * i + k + 1}]*v[{k + 1}]" for k in range(3)) + f" + ft[{i + 1}]" for i in range(3)]
    return f"""
        WITH {_motion_sql()},
        e AS (SELECT scene, recon, arg_min({{'gr': gr, 'gt': gt, 'pr': pr, 'pt': pt}}, image_id) AS f, arg_max({{'gr': gr, 'gt': gt, 'pr': pr, 'pt': pt}}, image_id) AS l FROM pose GROUP BY ALL),
        x AS (SELECT scene, recon, f.gr AS gr, f.gt AS ft, l.gt AS lt, [{", ".join(inner)}] AS v FROM e)
        SELECT scene, recon, round(sqrt({" + ".join(f"power({o} - lt[{i + 1}], 2)" for i, o in enumerate(outer))}), 5) AS error FROM x"""


SQL = {
    "views_upright": f"WITH {_V} {_placed_sql(_UP)}",
    "views_put_back": f"WITH {_V} {_placed_sql('SELECT vec_id, v, u, z, 4 AS h, 16 AS w FROM px', '')}",
    "views_cropped": f"""WITH {_V}, {_BOX} {_placed_sql('''SELECT vec_id, z, 10.0 AS f, 2*a AS h, 2*e AS w, v - (cy::INT - a) AS v, u - (cx::INT - e) AS u, a::DOUBLE AS cy, e::DOUBLE AS cx FROM b
        WHERE v >= cy - a AND v < cy + a AND u >= cx - e AND u < cx + e''')}""",
    "views_cropped_strictly": f"""WITH {_V}, {_BOX} {_placed_sql('''SELECT vec_id, z, 10.0 AS f, 4 AS h, 12 AS w, v - (cy::INT - sa) AS v, u - (cx::INT - se) AS u, sa::DOUBLE AS cy, se::DOUBLE AS cx FROM b
        WHERE v >= cy - sa AND v < cy - sa + 4 AND u >= cx - se AND u < cx - se + 12''')}""",
    "views_resized": f"""WITH {_V} {_placed_sql('''SELECT vec_id, z, 30.0 AS f, 12 AS h, 48 AS w, 3*v + i AS v, 3*u + j AS u, (cx + 0.5)*3 - 0.5 AS cx, (cy + 0.5)*3 - 0.5 AS cy
        FROM px, range(3) s(i), range(3) t(j)''')}""",
    "views_turned": f"""WITH {_V} {_placed_sql('''SELECT vec_id, z, 10.0 AS f, 16 AS h, 4 AS w, CASE WHEN vec_id % 2 = 0 THEN u ELSE 15 - u END AS v, CASE WHEN vec_id % 2 = 0 THEN 3 - v ELSE v END AS u,
        CASE WHEN vec_id % 2 = 0 THEN 4 - cy ELSE cy END AS cx, CASE WHEN vec_id % 2 = 0 THEN cx ELSE 16 - cx END AS cy FROM px''')}""",
    "views_padded": f"WITH {_V} {_placed_sql('SELECT vec_id, z, 10.0 AS f, 16 AS h, 16 AS w, v + 6 AS v, u, cx, cy + 6 AS cy FROM px')}",
    "views_prepared": "SELECT vec_id, 6::BIGINT AS h, 6::BIGINT AS w, true AS whole, true AS centered FROM embeddings WHERE len(embedding) = 64",
    "trajectory_errors": _rpe_sql(),
    "last_pose_errors": _last_sql(),
    "trajectory_centered": f"""WITH {_motion_sql()} SELECT scene, recon, image_id, {", ".join(f"round(gt[{i}] - avg(gt[{i}]) OVER (PARTITION BY scene, recon), 5) AS {c}" for i, c in ((1, "x"), (2, "y"), (3, "z")))} FROM pose""",
}
