"""Camera geometry as Column expressions.

Vectors and matrices are ARRAY<DOUBLE>, matrices row by row: 3x3 has 9 entries, 3x4 has 12, 4x4
has 16. Every function maps columns to a column without a UDF, so all of it stays in
generated code. Nulls give nulls.

Composed functions work on the entries of what they get, not on arrays of arrays, so expressions
stay small; a result used many times is best made a column of its own first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CAMERA_FOCALS

EPS = 1e-15


def _parts(v: Column) -> list[Column] | None:
    """The entries of an array made here."""
    return vars(v).get("_parts")


def at(v: Column, i: int) -> Column:
    parts = _parts(v)
    return F.get(v, F.lit(i)) if parts is None else parts[i]


def vector(v: Column, n: int) -> list[Column]:
    return [at(v, i) for i in range(n)]


def _rows(m: Column, width: int, rows: int = 3, cols: int = 3) -> list[list[Column]]:
    return [[at(m, r * width + c) for c in range(cols)] for r in range(rows)]


def dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def _known(c: Column) -> Column:
    return vars(c).get("_ok", None) if _parts(c) is not None else c.isNotNull()


def _whole(values: list[Column], *needed: Column) -> Column:
    """An array, or null where any input is null."""
    ok = _known(needed[0])
    for c in needed[1:]:
        if c is not needed[0]:
            ok = ok & _known(c)
    out = F.when(ok, F.array(*values))
    vars(out).update(_parts=values, _ok=ok)
    return out


# Rotations


def quat_wxyz_to_matrix(q: Column) -> Column:
    """Unit quaternion (w, x, y, z) to a 3x3 rotation."""
    w, x, y, z = vector(q, 4)
    return _whole([
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (z * x + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (z * x - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ], q)


def quat_xyzw_to_matrix(q: Column) -> Column:
    """Quaternion (x, y, z, w) of any length but 0 to a 3x3 rotation."""
    x, y, z, w = vector(q, 4)
    s = 2 / (x * x + y * y + z * z + w * w)
    return _whole([
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    ], q)


def matrix_to_quat_xyzw(r: Column) -> Column:
    """3x3 rotation to a quaternion (x, y, z, w) with w >= 0, from the best conditioned of four forms."""
    m = _rows(r, 3)
    t = [m[0][0], m[1][1], m[2][2]]
    size = [F.sqrt(F.greatest(v, F.lit(0.0))) for v in (1 + t[0] + t[1] + t[2], 1 + t[0] - t[1] - t[2], 1 - t[0] + t[1] - t[2], 1 - t[0] - t[1] + t[2])]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[1][0] + m[0][1], m[0][2] + m[2][0], m[1][2] + m[2][1]
    square = [v * v for v in size]
    # Four multiples of the same quaternion, in the order w, x, y, z.
    forms = [[square[0], a, b, c], [a, square[1], d, e], [b, d, square[2], f], [c, e, f, square[3]]]
    best = F.greatest(*size)

    def entry(i: int) -> Column:
        out = None
        for k in range(4):
            value = forms[k][i] / (2 * F.greatest(size[k], F.lit(0.1)))
            out = F.when(size[k] == best, value) if out is None else out.when(size[k] == best, value)
        return out

    sign = F.when(entry(0) < 0, -1.0).otherwise(1.0)
    return _whole([entry(i) * sign for i in (1, 2, 3, 0)], r)


def determinant(r: Column) -> Column:
    m = _rows(r, 3)
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def multiply(a: Column, b: Column) -> Column:
    """3x3 times 3x3."""
    x, y = _rows(a, 3), _rows(b, 3)
    return _whole([dot(x[r], [y[k][c] for k in range(3)]) for r in range(3) for c in range(3)], a, b)


def apply(m: Column, v: Column) -> Column:
    """3x3 times a vector of 3."""
    x, p = _rows(m, 3), vector(v, 3)
    return _whole([dot(row, p) for row in x], m, v)


def transpose(m: Column) -> Column:
    return _whole([at(m, c * 3 + r) for r in range(3) for c in range(3)], m)


# Rigid transforms


def rigid(rotation: Column, translation: Column) -> Column:
    """4x4 of a 3x3 rotation and a vector of 3."""
    r, t = _rows(rotation, 3), vector(translation, 3)
    zero, one = F.lit(0.0), F.lit(1.0)
    return _whole([*r[0], t[0], *r[1], t[1], *r[2], t[2], zero, zero, zero, one], rotation, translation)


def rotation_of(m: Column) -> Column:
    """The 3x3 part of a 3x4 or 4x4."""
    return _whole([at(m, r * 4 + c) for r in range(3) for c in range(3)], m)


def translation_of(m: Column) -> Column:
    return _whole([at(m, r * 4 + 3) for r in range(3)], m)


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rigid 3x4 or 4x4, as 4x4."""
    r = _rows(m, 4)
    t = [at(m, 3), at(m, 7), at(m, 11)]
    turned = [[r[k][i] for k in range(3)] for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return _whole([x for row in turned for x in [*row, -dot(row, t)]] + [zero, zero, zero, one], m)


def compose(a: Column, b: Column) -> Column:
    """Rigid a times rigid b (3x4 or 4x4), as 4x4."""
    x, y = _rows(a, 4), _rows(b, 4)
    ta, tb = [at(a, 3), at(a, 7), at(a, 11)], [at(b, 3), at(b, 7), at(b, 11)]
    zero, one = F.lit(0.0), F.lit(1.0)
    out = []
    for r in range(3):
        out += [dot(x[r], [y[k][c] for k in range(3)]) for c in range(3)] + [dot(x[r], tb) + ta[r]]
    return _whole(out + [zero, zero, zero, one], a, b)


def relative_pose(w2c_i: Column, w2c_j: Column) -> Column:
    """The pose of j seen from i: w2c_j times the inverse of w2c_i."""
    return compose(w2c_j, rigid_inverse(w2c_i))


def camera_center(w2c: Column) -> Column:
    return translation_of(rigid_inverse(w2c))


def center_distance(a: Column, b: Column) -> Column:
    """Distance of two centres (vectors of 3)."""
    x, y = vector(a, 3), vector(b, 3)
    return norm([p - q for p, q in zip(x, y)])


def transform_point(m: Column, p: Column) -> Column:
    """A point through a rigid or affine 3x4 or 4x4."""
    x, v = _rows(m, 4), vector(p, 3)
    return _whole([dot(row, v) + at(m, k * 4 + 3) for k, row in enumerate(x)], m, p)


def apply_similarity(scale: Column, rotation: Column, translation: Column, p: Column) -> Column:
    """scale * rotation * p + translation."""
    turned, t = apply(rotation, p), vector(translation, 3)
    return _whole([scale * at(turned, i) + t[i] for i in range(3)], rotation, translation, p)


# Errors of relative poses, in degrees


def angle_of_trace(trace: Column) -> Column:
    """Angle of a rotation with a trace: acos(1 - 2 max(1 - q^2, eps)), as q^2 of its quaternion is (trace + 1) / 4."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), 1 - 2 * F.greatest(1 - (trace + 1) / 4, F.lit(EPS)))))


def rotation_error(gt: Column, pred: Column) -> Column:
    """Angle between two 3x3 rotations."""
    return angle_of_trace(dot(vector(gt, 9), vector(pred, 9)))


def direction_angle(cosine: Column) -> Column:
    """Angle of two directions or their opposites by their cosine, 0 to 90; 1e6 radians in degrees where it is not finite."""
    angle = F.acos(F.sqrt(1 - F.greatest(1 - cosine * cosine, F.lit(EPS))))
    angle = F.degrees(F.when(F.isnan(angle) | (F.abs(angle) == float("inf")), F.lit(1e6)).otherwise(angle))
    return F.least(angle, F.abs(180 - angle))


def translation_error(gt: Column, pred: Column) -> Column:
    """Angle between two translations up to sign; 90 where one is zero."""
    a, b = vector(gt, 3), vector(pred, 3)
    return direction_angle(dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS)))


# Intrinsics (3x3)


def intrinsics(model: Column, params: Column) -> Column:
    """3x3 of a pinhole model with one focal length or two. Null for models with distortion."""
    zero, one = F.lit(0.0), F.lit(1.0)
    simple = F.array(at(params, 0), zero, at(params, 1), zero, at(params, 0), at(params, 2), zero, zero, one)
    full = F.array(at(params, 0), zero, at(params, 2), zero, at(params, 1), at(params, 3), zero, zero, one)
    return F.when(model == "SIMPLE_PINHOLE", simple).when(model == "PINHOLE", full)


def focal_lengths(model: Column, params: Column) -> Column:
    """[fx, fy] for any catalogued model: those with one focal length use it twice."""
    two = F.array(at(params, 0), at(params, 1))
    one = F.array(at(params, 0), at(params, 0))
    return F.when(model.isin(*[m for m, n in CAMERA_FOCALS.items() if n == 2]), two).when(model.isin(*[m for m, n in CAMERA_FOCALS.items() if n == 1]), one)


def _k(fx, fy, cx, cy) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(fx, zero, cx, zero, fy, cy, zero, zero, one)


def oriented_intrinsics(k: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Intrinsics after an EXIF orientation (1 to 8) is undone; mirrored points are W - cx."""
    fx, fy, cx, cy = at(k, 0), at(k, 4), at(k, 2), at(k, 5)
    w, h = width.cast("double"), height.cast("double")
    cases = {1: (fx, fy, cx, cy), 2: (fx, fy, w - cx, cy), 3: (fx, fy, w - cx, h - cy), 4: (fx, fy, cx, h - cy), 5: (fy, fx, cy, cx), 6: (fy, fx, h - cy, cx), 7: (fy, fx, h - cy, w - cx), 8: (fy, fx, cy, w - cx)}
    out = None
    for o, values in cases.items():
        out = F.when(orientation == o, _k(*values)) if out is None else out.when(orientation == o, _k(*values))
    return F.when(k.isNotNull(), out)


# Rotation of the camera for EXIF orientations; mirrored ones only in the full mode.
_TURNS = {3: (-1, 0, 0, 0, -1, 0, 0, 0, 1), 6: (0, 1, 0, -1, 0, 0, 0, 0, 1), 8: (0, -1, 0, 1, 0, 0, 0, 0, 1)}
_MIRRORS = {2: (-1, 0, 0, 0, 1, 0, 0, 0, 1), 4: (1, 0, 0, 0, -1, 0, 0, 0, 1), 5: (0, 1, 0, 1, 0, 0, 0, 0, 1), 7: (0, -1, 0, -1, 0, 0, 0, 0, 1)}
_SAME = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def orientation_rotation(orientation: Column, mirrored: bool = False) -> Column:
    """3x3 that turns the camera with its image. Unknown orientations, and mirrored ones unless asked for, turn nothing."""
    lit = lambda m: F.array(*[F.lit(float(x)) for x in m])
    out = F.when(orientation.isNull(), lit(_SAME))
    for o, m in (_TURNS | (_MIRRORS if mirrored else {})).items():
        out = out.when(orientation == o, lit(m))
    return out.otherwise(lit(_SAME))


def cropped_intrinsics(k: Column, left: Column, top: Column) -> Column:
    return F.when(k.isNotNull(), _k(at(k, 0), at(k, 4), at(k, 2) - left, at(k, 5) - top))


def padded_intrinsics(k: Column, left: Column, top: Column) -> Column:
    return cropped_intrinsics(k, -left, -top)


def resized_intrinsics(k: Column, scale: Column, pixel_center: bool = True) -> Column:
    """Intrinsics after a resize; with pixel centres at half pixels by default."""
    h = 0.5 if pixel_center else 0.0
    return F.when(k.isNotNull(), _k(at(k, 0) * scale, at(k, 4) * scale, (at(k, 2) + h) * scale - h, (at(k, 5) + h) * scale - h))


def centered_intrinsics(k: Column) -> Column:
    """From corner-based to centre-based pixel coordinates."""
    return cropped_intrinsics(k, F.lit(0.5), F.lit(0.5))


def quarter_turn_intrinsics(k: Column, width: Column, height: Column, clockwise: Column) -> Column:
    fx, fy, cx, cy = at(k, 0), at(k, 4), at(k, 2), at(k, 5)
    return F.when(clockwise, _k(fy, fx, height - cy, cx)).otherwise(_k(fy, fx, cy, width - cx))


def quarter_turn_extrinsics(m: Column, clockwise: Column) -> Column:
    """A 3x4 or 4x4 whose camera turns with its image, as 4x4."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    turn = F.when(clockwise, lit(_TURNS[8])).otherwise(lit(_TURNS[6]))
    return rigid(multiply(turn, rotation_of(m)), apply(turn, translation_of(m)))


def quarter_turn_track(xy: Column, width: Column, height: Column, clockwise: Column) -> Column:
    x, y = at(xy, 0), at(xy, 1)
    return F.when(clockwise, F.array(y, width - 1 - x)).otherwise(F.array(height - 1 - y, x))


def target_size(size: Column, patch: int) -> Column:
    """The greatest multiple of patch that is not over size."""
    return (F.floor(size / patch) * patch).cast("int")


def resize_scale(width: Column, height: Column, target_w: Column, target_h: Column, safe: float = 4.0) -> Column:
    """The scale at which an image covers the target and `safe` pixels."""
    return F.greatest((target_w + safe) / width, (target_h + safe) / height)


# Projection


def unproject(k: Column, u: Column, v: Column, z: Column, pixel_center: bool = False) -> list[Column]:
    """Camera coordinates of a pixel with depth z."""
    h = 0.5 if pixel_center else 0.0
    return [(u + h - at(k, 2)) * z / at(k, 0), (v + h - at(k, 5)) * z / at(k, 4), z]


def unproject_world(k: Column, w2c: Column, u: Column, v: Column, z: Column, pixel_center: bool = False) -> list[Column]:
    """World coordinates of a pixel with depth z: the transposed rotation times (camera point - translation)."""
    p = unproject(k, u, v, z, pixel_center)
    d = [p[0] - at(w2c, 3), p[1] - at(w2c, 7), p[2] - at(w2c, 11)]
    r = _rows(w2c, 4)
    return [dot([r[i][c] for i in range(3)], d) for c in range(3)]


def valid_depth(z: Column, eps: float = 1e-8) -> Column:
    return z > eps


def project(k: Column, w2c: Column, p: Column) -> list[Column]:
    """u, v and depth of a world point; at a depth of 0 it has no place."""
    c = vector(transform_point(w2c, p), 3)
    z = F.nullif(c[2], F.lit(0.0))
    return [at(k, 0) * c[0] / z + at(k, 2), at(k, 4) * c[1] / z + at(k, 5), c[2]]


def covisible(u: Column, v: Column, z: Column, width: Column, height: Column, seen: Column, tolerance: float = 0.05) -> Column:
    """Whether a projected point lies in an image whose depth there agrees with it."""
    inside = (z > 0) & (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)
    return F.coalesce(inside & (seen > 0) & (F.abs(z - seen) < seen * tolerance), F.lit(False))


def plucker(origin: list[Column], direction: list[Column]) -> list[Column]:
    """Direction and moment of a ray."""
    o, d = origin, direction
    n = norm(d)
    d = [x / n for x in d]
    return [*d, o[1] * d[2] - o[2] * d[1], o[2] * d[0] - o[0] * d[2], o[0] * d[1] - o[1] * d[0]]


# Pose encodings: translation (3), quaternion xyzw (4), vertical and horizontal field of view


def encode_pose(w2c: Column, k: Column, width: Column, height: Column) -> Column:
    q, t = matrix_to_quat_xyzw(rotation_of(w2c)), translation_of(w2c)
    fov_h, fov_w = 2 * F.atan(height / 2 / at(k, 4)), 2 * F.atan(width / 2 / at(k, 0))
    return _whole([*vector(t, 3), *vector(q, 4), fov_h, fov_w], w2c, k)


def decode_pose(code: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(4x4, 3x3) of an encoded pose, with the principal point in the middle."""
    entries = vector(code, 9)
    r = quat_xyzw_to_matrix(_whole(entries[3:7], code))
    fy, fx = height / 2 / F.tan(at(code, 7) / 2), width / 2 / F.tan(at(code, 8) / 2)
    return rigid(r, _whole(entries[:3], code)), _k(fx, fy, width / 2, height / 2)


# Depth


def inverse_depth(d: Column) -> Column:
    """1 / d where d > 0, else 0; its own inverse."""
    return F.when(d > 0, 1 / d).otherwise(0.0)


def activation(x: Column, kind: str) -> Column:
    """exp, expm1, inv_log (sign * expm1(|x|)), sigmoid, relu or linear."""
    return {"exp": F.exp(x), "expm1": F.expm1(x), "inv_log": F.signum(x) * F.expm1(F.abs(x)), "sigmoid": 1 / (1 + F.exp(-x)), "relu": F.greatest(x, F.lit(0.0)), "linear": x}[kind]
