"""Queries that run single functions and small operators over the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, raster
from ..functions import geometry as g
from ..operators import filters, samplers
from ..operators import graph as gr
from ..operators import metrics as mt
from ..operators import nearest as nn
from ..operators import registration as reg
from ..operators.quantiles import quantile
from ..scale import Workspace
from ..session import table
from ..sources import files
from . import depth, loader
from .graphs import match_graph

KEYS = ["scene", "recon"]


def _spread(prefix: str, m, n: int, digits: int = 6) -> list:
    return [F.round(g.at(m, i), digits).alias(f"{prefix}{i}") for i in range(n)]


# Poses and points


def _scaled_round(c: Column, digits: int) -> Column:
    """Rounds as SQL does, the scaled number. F.round takes the shortest decimal, which at a half goes the other way: 0.6807974999999999 times 1e6 is a half."""
    return F.round(c * 10.0**digits) / 10.0**digits


def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose of each image relative to the prediction of it."""
    rows = loader._moved(spark, sf_dir).select(*KEYS, "image_id", g.compose(g.rigid_inverse(F.col("gt")), F.col("pred")).alias("m"))
    return rows.select(*KEYS, "image_id", *_spread("m", F.col("m"), 12))


def orientation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the camera turns for each orientation that users' events stand for."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 9).cast("int").alias("o")).distinct()
    return rows.select("o", *[F.round(g.at(g.orientation_rotation(F.col("o"), True), i)).cast("int").alias(f"r{i}") for i in (0, 1, 3, 4, 8)])


def quarter_turn_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w2c = g.rigid_inverse(F.col("gt"))
    rows = loader._moved(spark, sf_dir).select(*KEYS, "image_id", g.quarter_turn_extrinsics(w2c, F.col("image_id") % 2 == 0).alias("m"), w2c.alias("was"))
    return rows.select(*KEYS, "image_id", *[_scaled_round(g.at(F.col("m"), i), 6).alias(f"m{i}") for i in (0, 3, 4, 7)], *[_scaled_round(g.at(F.col("was"), i), 6).alias(f"w{i}") for i in (3, 7)])


def covisible_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reconstruction, points projected into a fixed camera whose depth there is a little off."""
    k = F.array(*[F.lit(x) for x in (100.0, 0.0, 50.0, 0.0, 100.0, 40.0, 0.0, 0.0, 1.0)])
    w2c = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 0.0, 0.0, 0.0, 1.0)])
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz").distinct()
    u, v, z = g.project(k, w2c, F.col("xyz"))
    rows = rows.select(*KEYS, u.alias("u"), v.alias("v"), z.alias("z"), (z * (0.9 + (F.col("point3d_id") % 5) * 0.04)).alias("seen"))
    return rows.groupBy(*KEYS).agg(F.count_if(g.covisible(F.col("u"), F.col("v"), F.col("z"), F.lit(100), F.lit(80), F.col("seen"))).alias("covisible"), F.round(F.sum(F.when(F.col("z") > 0.1, F.col("z"))), 5).alias("depth"))


_S, _R, _T = 1.5, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0]


def similar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz").distinct()
    return rows.select(*KEYS, "point3d_id", *_spread("p", g.apply_similarity(F.lit(_S), lit(_R), lit(_T), F.col("xyz")), 3))


def ray_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from points in the direction of their colour."""
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz", "rgb").distinct()
    o = [F.get("xyz", F.lit(i)) for i in range(3)]
    d = [F.get("rgb", F.lit(i)).cast("double") + 1 for i in range(3)]
    return rows.select(*KEYS, "point3d_id", *[F.round(c, 6).alias(f"c{i}") for i, c in enumerate(g.plucker(o, d))])


def value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse depths, activations, sine codes, bytes and confidences of event values."""
    v = F.col("value")
    acts = [F.round(g.activation(v / 50 - 1, k), 6).alias(k) for k in ("exp", "expm1", "inv_log", "sigmoid", "relu", "linear")]
    code = mt.sine_code(v, 4)
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return rows.select(
        "event_id", F.round(g.inverse_depth(v - 20), 6).alias("inverse"), *acts, *[F.round(F.get(code, F.lit(i)), 6).alias(f"s{i}") for i in range(4)],
        files.byte_range(v, F.lit(0.0), F.lit(120.0)).alias("byte"), files.confident(v / 10 - 5).alias("sure"), g.target_size(v.cast("int"), 14).alias("size"),
    )


def fine_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(mt.auc_fine(F.col("value"), 60), 6).alias("auc"))


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of event values by rounds of counts, that keep 100 values of a type at most."""
    rows = table(spark, sf_dir, "events").where("event_type is not null").select("event_type", "value")
    a, b = (quantile(rows, ["event_type"], "value", s, 100) for s in (0.5, 0.98))
    return a.select("event_type", F.round("value", 6).alias("q50")).join(b.select("event_type", F.round("value", 6).alias("q98")), "event_type")


def trajectory_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.translation_of(F.col("gt"))
    rows = loader._moved(spark, sf_dir).select(*KEYS, *[g.at(p, i).alias(c) for i, c in enumerate("xyz")])
    return mt.main_axes(rows, KEYS)


def normal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of two clouds with cosines of normals, here made of the points' ids."""
    forward, backward = depth._neighbours(spark, sf_dir)
    dot = ((F.col("idx") * 7 + F.col("nn") * 13) % 201 - 100) / 100
    out = mt.reconstruction_summary(forward.withColumn("normal_dot", dot), backward.withColumn("normal_dot", dot), KEYS)
    return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("nc_acc", "nc_comp", "nc", "nc_median")])


def color_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab colours of points, as five images of a sequence, moved to the sequence's means."""
    rgb = [F.get("rgb", F.lit(i)).cast("double") for i in range(3)]
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "rgb").distinct()
    px = rows.select(*KEYS, "point3d_id", (F.col("point3d_id") % 5).alias("image"), *[c.alias(n) for n, c in zip("lab", color.rgb_to_lab(*rgb))], (F.col("point3d_id") % 3 > 0).alias("ok"))
    return color.matched_colors(px, KEYS, "image").select(*KEYS, "point3d_id", *[F.round(c, 4).alias(c) for c in "lab"])


# Work lists and paths


def work_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstructions of cameras that are in no list for training, with the image path of a depth file of theirs."""
    work = table(spark, sf_dir, "camera").select(F.concat("scene", F.lit(">"), "recon").alias("scene_recon_name")).distinct()
    left = filters.not_done(work, table(spark, sf_dir, "recon_split").where("split = 'train'"), ["scene_recon_name"])
    return left.select("scene_recon_name", filters.image_path(F.concat("scene_recon_name", F.lit(".jpg.geometric.bin")), "/images/").alias("path"))


def filled_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of two labels in three; the rest are zeros of their size."""
    rows = depth._rasters(spark, sf_dir)
    shown = table(spark, sf_dir, "embeddings").where("label % 3 < 2").select("vec_id")
    out = files.with_depth(rows.select("vec_id", "h", "w"), rows.join(shown, "vec_id", "left_semi").select("vec_id", "data"), "vec_id")
    stats = F.pandas_udf(depth._stats, "kept int, total double")
    return out.select("vec_id", "missing", stats("data").alias("s"), F.octet_length("data").alias("bytes")).select("vec_id", "missing", "bytes", "s.kept")


# Graph searches


def leaf_trees_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of trees with many leaves: per reconstruction, edges of the graph, each node reached once, one edge less than nodes."""
    edges = Workspace(spark, "hold").write(match_graph(spark, sf_dir)).df
    tree = Workspace(spark, "hold").write(samplers.leaf_trees(edges, KEYS)).df
    both = edges.select(*KEYS, F.col("src").alias("parent"), F.col("dst").alias("child")).unionAll(edges.select(*KEYS, "dst", "src"))
    real = tree.join(both, [*KEYS, "parent", "child"], "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("real"))
    ends = tree.select(*KEYS, F.explode(F.array("parent", "child")).alias("id")).groupBy(*KEYS).agg(F.countDistinct("id").alias("nodes"))
    per = tree.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("child").alias("children"))
    holds = (F.col("real") == F.col("n")) & (F.col("children") == F.col("n")) & (F.col("nodes") == F.col("n") + 1)
    return per.join(real, KEYS).join(ends, KEYS).select(*KEYS, holds.alias("holds"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images within three links of the alphabetically first image of each reconstruction's match graph, with the number of links."""
    from ..operators.components import growth

    edges = match_graph(spark, sf_dir)
    node = lambda c: F.struct(*KEYS, F.col(c).alias("id"))
    first = gr.nodes_of(edges, KEYS).groupBy(*KEYS).agg(F.min("id").alias("id"))
    links = edges.select(node("src").alias("src"), node("dst").alias("dst"), F.lit(1.0).alias("weight"))
    near = growth(first.select(node("id").alias("id")), links, 0.5, 3)
    return near.select(F.col("id.scene").alias("scene"), F.col("id.recon").alias("recon"), F.col("id.id").alias("id"), "depth")


# Rasters


def _two(kernel):
    """A query: what a kernel of a raster and the next one leaves."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = depth._rasters(spark, sf_dir)
        other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("data").alias("other"))
        udf, stats = raster.raster_udf(lambda z, bits: kernel(z.astype(float), bits.view("float32").astype(float)), True), F.pandas_udf(depth._stats, "kept int, total double")
        return rows.join(other, "vec_id").select("vec_id", udf("h", "w", "data", "other").alias("data")).select("vec_id", stats("data").alias("s")).select("vec_id", "s.kept", F.round("s.total", 3).alias("total"))

    return query


photometric_swap = _two(raster.swap_photometric)
sky_cut = depth._left_by(raster.cut_sky, True)


def ordinal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far background of rasters, by number of pixels."""

    def far(h: pd.Series, w: pd.Series, data: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([int((raster.ordinal(np.frombuffer(d, "<f4").reshape(a, b).astype(float), np.frombuffer(c, "<i4").reshape(a, b)) == 2).sum()) for a, b, d, c in zip(h, w, data, classes)])

    return depth._rasters(spark, sf_dir).select("vec_id", F.pandas_udf(far, "int")("h", "w", "data", "classes").alias("far"))


def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of valid pixels: how many, and the size of the largest."""

    def label(data: pd.Series) -> pd.DataFrame:
        out = [raster.label(np.frombuffer(d, "<f4").reshape(8, 8) > 0) for d in data]
        return pd.DataFrame({"n": [n for _, n in out], "largest": [int(np.bincount(x.ravel())[1:].max()) if n else 0 for x, n in out]})

    return depth._rasters(spark, sf_dir).select("vec_id", F.pandas_udf(label, "n int, largest int")("data").alias("s")).select("vec_id", "s.*")


# Registration


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a reconstruction as three chunks that overlap, each in coordinates of its own, merged in those of the first."""
    rows = table(spark, sf_dir, "point3d").select(*KEYS, "point3d_id", "xyz").distinct().where("xyz[0] is not null")
    enough = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 60").select(*KEYS)
    rows = rows.join(enough, KEYS, "left_semi").withColumn("frame", (F.col("point3d_id") % 8).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.where((F.col("frame") >= F.col("chunk") * 2) & (F.col("frame") < F.col("chunk") * 2 + 4))
    x, y, z, c = F.get("xyz", F.lit(0)), F.get("xyz", F.lit(1)), F.get("xyz", F.lit(2)), F.col("chunk")
    turn = F.when(c == 1, F.array(-y, x, z)).when(c == 2, F.array(x, -z, y)).otherwise(F.array(x, y, z))
    own = F.transform(turn, lambda v: v * (1 + c * 0.5) + c)
    chunks = rows.select(*KEYS, "chunk", "frame", F.col("point3d_id").alias("pix"), *[F.get(own, F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    out = reg.merge_chunks(chunks, KEYS)
    return out.select(*KEYS, "frame", "pix", *[F.round(c, 3).alias(c) for c in "xyz"], "votes")


def robust_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the robust Sim(3) of whole clouds without pairs finds the scale of the prediction to a hundredth."""
    gt, pred = depth._clouds(spark, sf_dir)
    enough = gt.where("x is not null").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 40").select(*KEYS)
    fit = reg.robust_alignment(pred.join(enough, KEYS, "left_semi"), gt.join(enough, KEYS, "left_semi"), KEYS, most=None)
    return fit.select(*KEYS, (F.abs(F.col("s") - 1 / 1.01) < 0.01).alias("near"))


_FUNCTIONS = (
    relative_poses, orientation_turns, quarter_turn_poses, covisible_points, similar_points, ray_codes, value_codes, fine_auc, value_quantiles, trajectory_axes, normal_consistency, color_transfer, work_left, filled_depths,
    leaf_trees_hold, hops, ordinal_labels, component_labels, merged_chunks, robust_fits,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"photometric_swap": photometric_swap, "sky_cut": sky_cut}

_POINTS = "p AS (SELECT DISTINCT scene, recon, point3d_id, xyz, rgb FROM point3d)"
_LAB = """
    n AS (SELECT scene, recon, point3d_id, list_transform(rgb, lambda c: CASE WHEN c / 255.0::DOUBLE > 0.04045 THEN pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE c / 255.0::DOUBLE / 12.92 END) AS i FROM p),
    x AS (SELECT *, [(0.412453*i[1] + 0.357580*i[2] + 0.180423*i[3]) / 0.950456, 0.212671*i[1] + 0.715160*i[2] + 0.072169*i[3], (0.019334*i[1] + 0.119193*i[2] + 0.950227*i[3]) / 1.088754] AS t FROM n),
    f AS (SELECT *, list_transform(t, lambda v: CASE WHEN v > 0.008856 THEN cbrt(v) ELSE 7.787*v + 16/116.0::DOUBLE END) AS f FROM x),
    lab AS (SELECT scene, recon, point3d_id, point3d_id % 5 AS image, point3d_id % 3 > 0 AS ok, 116*f[2] - 16 AS l, 500*(f[1] - f[2]) AS a, 200*(f[2] - f[3]) AS b FROM f)"""
_REL_R, _REL_T = loader._relative("gr", "pr", "gt", "pt")
_F32 = "f AS (SELECT vec_id, v, u, (z::FLOAT)::DOUBLE AS z FROM px)"
_REACH = """reach AS (SELECT vec_id, v, u, v AS y, u AS x FROM core UNION
    SELECT r.vec_id, r.v, r.u, c.v, c.u FROM reach r JOIN core c ON c.vec_id = r.vec_id AND abs(c.v - r.y) + abs(c.u - r.x) = 1),
    part AS (SELECT vec_id, v, u, count(*) AS size, min(y * 8 + x) AS root FROM reach GROUP BY ALL)"""
_TURNS = {1: (1, 0, 0, 1), 2: (-1, 0, 0, 1), 3: (-1, 0, 0, -1), 4: (1, 0, 0, -1), 5: (0, 1, 1, 0), 6: (0, 1, -1, 0), 7: (0, -1, -1, 0), 8: (0, -1, 1, 0)}

SQL = {
    "relative_poses": f"""WITH {loader._motion_sql()} SELECT scene, recon, image_id, {", ".join(f"round({c}, 6) + 0 AS m{4 * (i // 3) + i % 3}" for i, c in enumerate(_REL_R))}, {", ".join(f"round({c}, 6) + 0 AS m{4 * i + 3}" for i, c in enumerate(_REL_T))} FROM pose""",
    "orientation_turns": "SELECT DISTINCT (user_id % 9)::INT AS o, " + ", ".join(
        f"CASE user_id % 9 {' '.join(f'WHEN {o} THEN {m[i]}' for o, m in _TURNS.items())} ELSE {(1, 0, 0, 1)[i]} END::INT AS r{n}" for i, n in enumerate((0, 1, 3, 4))
    ) + ", 1::INT AS r8 FROM events",
    "quarter_turn_poses": f"""
        WITH {loader._motion_sql()}, w AS (SELECT scene, recon, image_id, image_id % 2 = 0 AS c, gr[1] AS a, gr[2] AS d, {" , ".join(f"-(gr[{i + 1}]*gt[1] + gr[{i + 4}]*gt[2] + gr[{i + 7}]*gt[3]) AS t{i}" for i in range(2))} FROM pose)
        SELECT scene, recon, image_id, round(CASE WHEN c THEN -d ELSE d END, 6) AS m0, round(CASE WHEN c THEN -t1 ELSE t1 END, 6) AS m3, round(CASE WHEN c THEN a ELSE -a END, 6) AS m4,
               round(CASE WHEN c THEN t0 ELSE -t0 END, 6) AS m7, round(t0, 6) AS w3, round(t1, 6) AS w7 FROM w""",
    "covisible_points": f"""
        WITH {_POINTS}, q AS (SELECT scene, recon, 100*xyz[1]/(xyz[3]+5) + 50 AS u, 100*xyz[2]/(xyz[3]+5) + 40 AS v, xyz[3]+5 AS z, (xyz[3]+5) * (0.9::DOUBLE + (point3d_id % 5) * 0.04::DOUBLE) AS seen FROM (SELECT DISTINCT scene, recon, point3d_id, xyz FROM p))
        SELECT scene, recon, count_if(z > 0 AND u BETWEEN 0 AND 99 AND v BETWEEN 0 AND 79 AND seen > 0 AND abs(z - seen) / seen < 0.05)::BIGINT AS covisible, round(sum(z) FILTER (z > 0.1), 5) AS depth FROM q GROUP BY ALL""",
    "similar_points": "WITH p AS (SELECT DISTINCT scene, recon, point3d_id, xyz FROM point3d) SELECT scene, recon, point3d_id, round(1 - 1.5*xyz[2], 6) AS p0, round(2 + 1.5*xyz[1], 6) AS p1, round(3 + 1.5*xyz[3], 6) AS p2 FROM p",
    "ray_codes": f"""
        WITH {_POINTS}, n AS (SELECT *, sqrt((rgb[1]+1)::DOUBLE*(rgb[1]+1) + (rgb[2]+1)::DOUBLE*(rgb[2]+1) + (rgb[3]+1)::DOUBLE*(rgb[3]+1)) AS l FROM p),
        d AS (SELECT scene, recon, point3d_id, xyz AS o, [(rgb[1]+1)/l, (rgb[2]+1)/l, (rgb[3]+1)/l] AS d FROM n)
        SELECT scene, recon, point3d_id, round(d[1], 6) AS c0, round(d[2], 6) AS c1, round(d[3], 6) AS c2, round(o[2]*d[3] - o[3]*d[2], 6) AS c3, round(o[3]*d[1] - o[1]*d[3], 6) AS c4, round(o[1]*d[2] - o[2]*d[1], 6) AS c5 FROM d""",
    "value_codes": """
        WITH e AS (SELECT event_id, value AS v, value/50 - 1 AS x FROM events)
        SELECT event_id, round(CASE WHEN v > 20 THEN 1/(v - 20) ELSE 0 END, 6) AS inverse, round(exp(x), 6) AS exp, round(exp(x) - 1, 6) AS expm1, round(sign(x)*(exp(abs(x)) - 1), 6) AS inv_log, round(1/(1 + exp(-x)), 6) AS sigmoid,
               round(greatest(x, 0), 6) AS relu, round(x, 6) AS linear, round(sin(v), 6) AS s0, round(sin(v/100), 6) AS s1, round(cos(v), 6) AS s2, round(cos(v/100), 6) AS s3,
               floor(v/120*255)::INT AS byte, 1/(1 + exp(5 - v/10)) > 0.2 AS sure, (floor(trunc(v)/14)*14)::INT AS size FROM e""",
    "fine_auc": "SELECT user_id, round(avg(CASE WHEN value BETWEEN 0 AND 60 THEN (61 - least(floor(value*61/60), 60)) / 61 ELSE 0 END), 6) AS auc FROM events GROUP BY user_id",
    "value_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.98), 6) AS q98 FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "trajectory_axes": f"""
        WITH {loader._motion_sql()}, v AS (SELECT scene, recon, var_pop(gt[1]) AS x, var_pop(gt[2]) AS y, var_pop(gt[3]) AS z FROM pose GROUP BY ALL),
        l AS (SELECT scene, recon, list_sort([{{'v': -x, 'a': 'x'}}, {{'v': -y, 'a': 'y'}}, {{'v': -z, 'a': 'z'}}]) AS s FROM v) SELECT scene, recon, s[1].a || s[2].a AS axes FROM l""",
    "normal_consistency": f"""
        WITH {depth._NN}, d AS (SELECT scene, recon, abs(((idx*7 + nn*13) % 201 - 100) / 100) AS n, 'a' AS side FROM f UNION ALL SELECT scene, recon, abs(((idx*7 + nn*13) % 201 - 100) / 100), 'c' FROM b),
        m AS (SELECT scene, recon, avg(n) FILTER (side = 'a') AS a, avg(n) FILTER (side = 'c') AS c, median(n) FILTER (side = 'a') AS ma, median(n) FILTER (side = 'c') AS mc FROM d GROUP BY ALL)
        SELECT scene, recon, round(a, 6) AS nc_acc, round(c, 6) AS nc_comp, round((a + c)/2, 6) AS nc, round((ma + mc)/2, 6) AS nc_median FROM m""",
    "color_transfer": f"""
        WITH {_POINTS}, {_LAB},
        s AS (SELECT scene, recon, image, {", ".join(f"avg({c}) FILTER (ok) AS m{c}, stddev_pop({c}) FILTER (ok) AS s{c}" for c in "lab")} FROM lab GROUP BY ALL),
        w AS (SELECT scene, recon, {", ".join(f"avg(m{c}) AS tm{c}, avg(s{c}) AS ts{c}" for c in "lab")} FROM s GROUP BY ALL)
        SELECT scene, recon, point3d_id, {", ".join(f"round(coalesce(({c} - m{c}) / (s{c} + 1e-6) * ts{c} + tm{c}, {c}), 4) AS {c}" for c in "lab")} FROM lab JOIN s USING (scene, recon, image) JOIN w USING (scene, recon)""",
    "work_left": """
        SELECT DISTINCT scene || '>' || recon AS scene_recon_name, '/images/' || scene || '>' || recon || '.jpg' AS path FROM camera
        WHERE scene || '>' || recon NOT IN (SELECT scene_recon_name FROM recon_split WHERE split = 'train' AND scene_recon_name IS NOT NULL)""",
    "filled_depths": f"WITH {depth._PIX} SELECT vec_id, label % 3 = 2 AS missing, 256::INT AS bytes, CASE WHEN label % 3 = 2 THEN 0 ELSE count_if(z > 0) END::INT AS kept FROM px GROUP BY vec_id, label",
    "leaf_trees_hold": "SELECT DISTINCT scene, recon, true AS holds FROM presampling_pairs WHERE matches_num > 16 AND replace(src, ' ', '_') <> replace(dst, ' ', '_')",
    "photometric_swap": f"""WITH {depth._PIX}, {_F32}, out AS (SELECT a.vec_id, CASE WHEN a.z / (b.z + 1e-6) > 1.1 THEN b.z ELSE a.z END AS z FROM f a JOIN f b ON b.vec_id = a.vec_id + 1 AND b.v = a.v AND b.u = a.u) {depth._KEPT}""",
    "sky_cut": f"WITH {depth._PIX}, {_F32}, out AS (SELECT vec_id, CASE WHEN v < 2 THEN 0 ELSE z END AS z FROM f) {depth._KEPT}",
    "component_labels": f"""
        WITH RECURSIVE {depth._PIX}, core AS (SELECT vec_id, v, u FROM px WHERE z::FLOAT > 0), {_REACH}
        SELECT e.vec_id, count(DISTINCT root)::INT AS n, coalesce(max(size), 0)::INT AS largest FROM embeddings e LEFT JOIN part USING (vec_id) GROUP BY e.vec_id""",
    "ordinal_labels": f"""
        WITH RECURSIVE {depth._PIX}, {_F32}, core AS (SELECT vec_id, v, u FROM f WHERE v >= 6 AND z > 0), {_REACH},
        cut AS (SELECT vec_id, quantile_cont(z, 0.75) AS c FROM f WHERE v >= 6 AND z > 0 GROUP BY vec_id)
        SELECT e.vec_id, count_if(size > 3.2 AND z >= c)::INT AS far FROM embeddings e LEFT JOIN part USING (vec_id) LEFT JOIN f ON f.vec_id = part.vec_id AND f.v = part.v AND f.u = part.u LEFT JOIN cut ON cut.vec_id = e.vec_id GROUP BY e.vec_id""",
    "merged_chunks": """
        WITH p AS (SELECT DISTINCT scene, recon, point3d_id, xyz FROM point3d WHERE xyz[1] IS NOT NULL), k AS (SELECT scene, recon FROM p GROUP BY ALL HAVING count(*) >= 60)
        SELECT scene, recon, (point3d_id % 8)::INT AS frame, point3d_id AS pix, round(xyz[1], 3) + 0 AS x, round(xyz[2], 3) + 0 AS y, round(xyz[3], 3) + 0 AS z,
               CASE WHEN point3d_id % 8 IN (2, 3, 4, 5) THEN 2 ELSE 1 END::INT AS votes FROM p JOIN k USING (scene, recon)""",
    "robust_fits": "SELECT scene, recon, true AS near FROM (SELECT DISTINCT scene, recon, point3d_id, xyz FROM point3d WHERE xyz[1] IS NOT NULL) GROUP BY ALL HAVING count(*) >= 40",
    "hops": """
        WITH RECURSIVE m AS (SELECT DISTINCT scene, recon, replace(src, ' ', '_') AS a, replace(dst, ' ', '_') AS b FROM presampling_pairs WHERE matches_num > 16 AND replace(src, ' ', '_') <> replace(dst, ' ', '_')),
        l AS (SELECT * FROM m UNION SELECT scene, recon, b, a FROM m),
        r AS (SELECT scene, recon, min(a) AS id, 0 AS depth FROM l GROUP BY scene, recon UNION SELECT r.scene, r.recon, l.b, r.depth + 1 FROM r JOIN l ON l.scene = r.scene AND l.recon = r.recon AND l.a = r.id WHERE r.depth < 3)
        SELECT scene, recon, id, min(depth)::INT AS depth FROM r GROUP BY ALL""",
}
