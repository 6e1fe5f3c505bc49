"""Pose, reconstruction, depth and trajectory metrics: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from .quantiles import quantile

THRESHOLDS = (5, 15, 30)


def pose_pairs(poses: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, i < j, r_error, t_error in degrees for all pairs of frames of a sequence.

    poses: keys, frame, gt, pred as world-to-camera 4x4 (16 doubles). Frames without either are left out.
    What a pair needs is prepared per frame: the turn m = pred' gt and both camera centres. The trace of the
    relative rotations' difference is the product of two m, and relative translations are differences of
    centres, turned by the second frame; so a pair costs some forty multiplications.
    """
    whole = poses.where(F.col("gt").isNotNull() & F.col("pred").isNotNull())
    turn = g.multiply(g.transpose(g.rotation_of(F.col("pred"))), g.rotation_of(F.col("gt")))
    per = whole.select(*keys, F.col(frame).alias("f"), turn.alias("m"), g.camera_center(F.col("gt")).alias("c"), g.camera_center(F.col("pred")).alias("d"))
    # Each frame meets all of its sequence: few bytes, much work, so frames are spread over all tasks by number, not by size.
    tasks = int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = per.toDF(*keys, "i", "mi", "ci", "di").repartition(tasks, *keys, "i").join(per.toDF(*keys, "j", "mj", "cj", "dj"), keys).where("i < j")
    vec = lambda c, n: g.vector(F.col(c), n)
    trace = g.dot(vec("mi", 9), vec("mj", 9))
    gt = [x - y for x, y in zip(vec("ci", 3), vec("cj", 3))]
    pred = [x - y for x, y in zip(vec("di", 3), vec("dj", 3))]
    m = vec("mj", 9)
    turned = [g.dot([m[3 * r + k] for k in range(3)], gt) for r in range(3)]
    pairs = both.select(*keys, "i", "j", trace.alias("trace"), g.dot(turned, pred).alias("p"), g.norm(gt).alias("ng"), g.norm(pred).alias("np"))
    r = g.angle_of_trace(F.col("trace"))
    t = g.direction_angle(F.col("p") / ((F.col("ng") + g.EPS) * (F.col("np") + g.EPS)))
    return pairs.select(*keys, "i", "j", r.alias("r_error"), t.alias("t_error"))


def accuracy(error: Column, threshold: float) -> Column:
    """Per cent of errors under a threshold."""
    return F.avg(F.when(error < threshold, 100.0).otherwise(0.0))


def auc(error: Column, threshold: int) -> Column:
    """Per cent of the area under the recall curve over whole degrees up to the threshold, in one pass.

    An error e counts for the bins that end after it; the last bin is closed and what is above it counts for none."""
    share = (threshold - F.least(F.floor(error), F.lit(threshold - 1))) / threshold
    return F.avg(F.when(error <= threshold, share).otherwise(0.0)) * 100


def auc_fine(error: Column, threshold: int) -> Column:
    """The variant with threshold + 1 bins of equal width between 0 and the threshold."""
    bins = threshold + 1
    bin_of = F.least(F.floor(error * bins / threshold), F.lit(bins - 1))
    return F.avg(F.when((error >= 0) & (error <= threshold), (bins - bin_of) / bins).otherwise(0.0))


def pose_summary(pairs: DataFrame, keys: list[str], thresholds: tuple[int, ...] = THRESHOLDS, in_rounds: bool = False) -> DataFrame:
    """Accuracies, AUC, means and medians over all pairs of the groups (a micro average). Medians are exact; in_rounds finds them by
    rounds of counts, for groups whose distinct errors don't fit one task. pairs should then be a written table."""
    both = F.greatest("r_error", "t_error")
    aggs = []
    for t in thresholds:
        aggs += [accuracy(F.col("r_error"), t).alias(f"racc_{t}"), accuracy(F.col("t_error"), t).alias(f"tacc_{t}"), auc(both, t).alias(f"auc_{t}")]
    for c in ("r_error", "t_error"):
        aggs.append(F.avg(c).alias(f"mean_{c}"))
        if not in_rounds:
            aggs.append(F.percentile(c, F.lit(0.5)).alias(f"median_{c}"))
    out = pairs.groupBy(*keys).agg(*aggs)
    for c in ("r_error", "t_error") if in_rounds else ():
        out = out.join(quantile(pairs, keys, c, 0.5).withColumnRenamed("value", f"median_{c}"), keys, "left")
    return out


def lower_median(c: str) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")


def macro_average(rows: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Means over sequences that skip NaN as well as null."""
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]
    return rows.groupBy(*keys).agg(*means)


def reconstruction_summary(accuracy_nn: DataFrame, completion_nn: DataFrame, keys: list[str], threshold: float = 0.05) -> DataFrame:
    """Accuracy and completion (mean and median distance), the completion ratio, and normal consistency
    where the neighbours carry normal_dot, the cosine of the two normals."""

    def side(df: DataFrame, name: str) -> DataFrame:
        aggs = [F.avg("distance").alias(name), F.percentile("distance", F.lit(0.5)).alias(f"{name}_median")]
        if name == "comp":
            aggs.append(F.avg((F.col("distance") < threshold).cast("double")).alias("comp_ratio"))
        if "normal_dot" in df.columns:
            aggs += [F.avg(F.abs("normal_dot")).alias(f"nc_{name}"), F.percentile(F.abs("normal_dot"), F.lit(0.5)).alias(f"nc_{name}_median")]
        return df.groupBy(*keys).agg(*aggs)

    out = side(accuracy_nn, "acc").join(side(completion_nn, "comp"), keys)
    if "nc_acc" in out.columns and "nc_comp" in out.columns:
        out = out.withColumn("nc", (F.col("nc_acc") + F.col("nc_comp")) / 2)
        out = out.withColumn("nc_median", (F.col("nc_acc_median") + F.col("nc_comp_median")) / 2)
    return out


# Depth


def depth_scale(pairs: DataFrame, keys: list[str], method: str, rounds: int = 10) -> DataFrame:
    """keys, s, t so that s * pred + t fits gt: none, median, lstsq, lad (least absolute scale and shift, by
    reweighting from lstsq), or irls (least absolute scale, by reweighting from the ratio of means).
    Each round of reweighting is one aggregation."""
    valid = pairs.where("gt > 0")
    if method == "none":
        return valid.groupBy(*keys).agg(F.lit(1.0).alias("s"), F.lit(0.0).alias("t"))
    if method == "median":
        return valid.groupBy(*keys).agg((lower_median("gt") / lower_median("pred")).alias("s"), F.lit(0.0).alias("t"))
    if method == "lstsq":
        return valid.groupBy(*keys).agg(F.regr_slope("gt", "pred").alias("s"), F.regr_intercept("gt", "pred").alias("t"))
    if method == "lad":
        fit = valid.groupBy(*keys).agg(F.regr_slope("gt", "pred").alias("s"), F.regr_intercept("gt", "pred").alias("t"))
        for _ in range(rounds):
            w = 1 / (F.abs(F.col("s") * F.col("pred") + F.col("t") - F.col("gt")) + 1e-8)
            sums = {"w": w, "x": w * F.col("pred"), "y": w * F.col("gt"), "xx": w * F.col("pred") * F.col("pred"), "xy": w * F.col("pred") * F.col("gt")}
            step = valid.join(fit, keys).groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
            slope = (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x"))
            fit = step.withColumn("s", slope).withColumn("t", (F.col("_y") - F.col("s") * F.col("_x")) / F.col("_w")).select(*keys, "s", "t")
        return fit
    if method != "irls":
        raise ValueError(method)
    scales = valid.groupBy(*keys).agg((F.avg("gt") / F.avg("pred")).alias("s"))
    for _ in range(rounds):
        w = 1 / (F.abs(F.col("s") * F.col("pred") - F.col("gt")) + 1e-8)
        step = valid.join(scales, keys).groupBy(*keys)
        scales = step.agg((F.sum(w * F.col("pred") * F.col("gt")) / F.sum(w * F.col("pred") * F.col("pred"))).alias("s"))
    return scales.select(*keys, F.greatest("s", F.lit(1e-3)).alias("s"), F.lit(0.0).alias("t"))


def align_depth(pairs: DataFrame, scales: DataFrame, keys: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    out = pairs.join(scales, keys).withColumn("pred", F.col("s") * F.col("pred") + F.col("t")).drop("s", "t")
    if low is not None:
        out = out.withColumn("pred", F.greatest("pred", F.lit(low)))
    if high is not None:
        out = out.withColumn("pred", F.least("pred", F.lit(high)))
    return out


def depth_errors(pairs: DataFrame, keys: list[str], most: float | None = None) -> DataFrame:
    """abs_rel, sq_rel, rmse, log_rmse, d0 (always 0), d1, d2, d3, valid: over pixels with 0 < gt (< most); all 0 if there is none."""
    ok = F.coalesce(F.col("gt") > 0, F.lit(False)) & F.col("pred").isNotNull()
    if most is not None:
        ok = ok & (F.col("gt") < most)
    gt, pred = F.when(ok, F.col("gt")), F.when(ok, F.col("pred"))
    clamped = F.greatest(pred, F.lit(1e-5))
    ratio = F.greatest(clamped / gt, gt / clamped)
    under = lambda t: F.coalesce(F.avg(F.when(ok, (ratio < t).cast("double"))), F.lit(0.0))
    log = F.log(clamped) - F.log(gt)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.groupBy(*keys).agg(
        zero(F.avg(F.abs(pred - gt) / gt)).alias("abs_rel"), zero(F.avg((pred - gt) * (pred - gt) / gt)).alias("sq_rel"),
        zero(F.sqrt(F.avg((pred - gt) * (pred - gt)))).alias("rmse"), zero(F.sqrt(F.avg(log * log))).alias("log_rmse"),
        under(1.0).alias("d0"), under(1.25).alias("d1"), under(1.25**2).alias("d2"), under(1.25**3).alias("d3"), F.count(gt).alias("valid"),
    )


# Trajectories


def relative_motion(poses: DataFrame, keys: list[str], ts: str, pose: str) -> DataFrame:
    """poses with motion, the pose relative to the one before (null at the first)."""
    before = F.lag(pose).over(Window.partitionBy(*keys).orderBy(ts))
    return poses.withColumn("motion", g.compose(g.rigid_inverse(before), F.col(pose)))


def trajectory_errors(poses: DataFrame, keys: list[str], ts: str, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """keys, ate, rpe_t, rpe_r (degrees), n: RMSE of positions, and of motions between neighbouring frames. Poses are camera-to-world and aligned."""
    both = poses.where(F.col(gt).isNotNull() & F.col(pred).isNotNull())
    moved = relative_motion(both, keys, ts, gt).withColumnRenamed("motion", "__g")
    moved = relative_motion(moved, keys, ts, pred).withColumnRenamed("motion", "__p")
    off = g.compose(g.rigid_inverse(F.col("__g")), F.col("__p"))
    d = g.center_distance(g.translation_of(F.col(gt)), g.translation_of(F.col(pred)))
    trace = g.at(off, 0) + g.at(off, 5) + g.at(off, 10)
    angle = F.when(trace.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))))  # the first frame has no motion
    shift = g.norm(g.vector(g.translation_of(off), 3))
    rows = moved.select(*keys, d.alias("d"), shift.alias("s"), angle.alias("a"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return rows.groupBy(*keys).agg(rms("d").alias("ate"), rms("s").alias("rpe_t"), rms("a").alias("rpe_r"), F.count(F.lit(1)).alias("n"))


def last_pose_error(poses: DataFrame, keys: list[str], ts: str, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """keys, error: distance of the last positions once the first poses are made equal."""
    ends = poses.groupBy(*keys).agg(*[f(c, ts).alias(f"{n}_{c}") for c in (gt, pred) for n, f in (("first", F.min_by), ("last", F.max_by))])
    # Only the position is asked for: out of the first predicted frame, and into the first true one.
    p, t = F.col(f"first_{pred}"), F.col(f"last_{pred}")
    away = [g.at(t, 4 * i + 3) - g.at(p, 4 * i + 3) for i in range(3)]
    local = F.array(*[sum((g.at(p, 4 * k + i) * away[k] for k in range(3)), F.lit(0.0)) for i in range(3)])
    moved = g.transform_point(F.col(f"first_{gt}"), local)
    return ends.select(*keys, g.center_distance(moved, g.translation_of(F.col(f"last_{gt}"))).alias("error"))


def main_axes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axes: the two axes of greatest variance, for a plot of a trajectory."""
    v = points.groupBy(*keys).agg(*[F.var_pop(c).alias(c) for c in "xyz"])
    ordered = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("axis")) for c in "xyz"]))
    return v.select(*keys, F.concat(F.get(ordered, F.lit(0))["axis"], F.get(ordered, F.lit(1))["axis"]).alias("axes"))


def confidence_weights(rows: DataFrame, keys: list[str], conf: str, high: float = 0.8, low: float = 0.1) -> DataFrame:
    """rows with weight: the confidence between two quantiles of its group, clamped to 0 and 1."""
    q = rows.groupBy(*keys).agg(F.percentile(conf, F.lit(high)).alias("__h"), F.percentile(conf, F.lit(low)).alias("__l"))
    w = (F.col(conf) - F.col("__l")) / (F.col("__h") - F.col("__l") + 1e-3)
    return rows.join(q, keys).withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))).drop("__h", "__l")


def first_visible(tracks: DataFrame, keys: list[str], frame: str, value: str, visible: str) -> DataFrame:
    """keys, value of the first frame in which a track is visible; null if it never is."""
    return tracks.groupBy(*keys).agg(F.min_by(F.when(F.col(visible), F.col(value)), F.when(F.col(visible), F.col(frame))).alias(value))


def sine_code(position: Column, size: int, base: float = 10_000.0) -> Column:
    """Sines, then cosines, of a position at falling frequencies."""
    rates = [base ** (-2 * i / size) for i in range(size // 2)]
    return F.array(*[f(position * r) for f in (F.sin, F.cos) for r in rates])
