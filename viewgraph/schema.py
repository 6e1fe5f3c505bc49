"""Tables of multi-view collections."""

from __future__ import annotations

# Camera models with their ids and numbers of parameters.
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": (0, 3), "PINHOLE": (1, 4), "SIMPLE_RADIAL": (2, 4), "RADIAL": (3, 5), "OPENCV": (4, 8), "OPENCV_FISHEYE": (5, 8),
    "FULL_OPENCV": (6, 12), "FOV": (7, 5), "SIMPLE_RADIAL_FISHEYE": (8, 4), "RADIAL_FISHEYE": (9, 5), "THIN_PRISM_FISHEYE": (10, 12),
}
CAMERA_IDS = {i: (name, n) for name, (i, n) in CAMERA_MODELS.items()}
#: How many focal lengths come first among the parameters of a model.
CAMERA_FOCALS = {m: 1 if m in ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE") else 2 for m in CAMERA_MODELS}

CAMERA = "camera_id int, model string, width long, height long, params array<double>"
IMAGE = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, xys array<array<double>>, point3d_ids array<long>"
POINT3D = "point3d_id long, xyz array<double>, rgb array<short>, error double, image_ids array<int>, point2d_idxs array<int>"
RASTER = "path string, h int, w int, data binary"
EDGE = "src string, dst string, weight long, common_pts long, distance double"
SAMPLE = "imgs map<string, struct<c2w array<array<double>>, k array<array<double>>, depth_path string>>, edges array<struct<src string, dst string>>"

#: Ids of the pair key: id1 * PAIR_BASE + id2 with id1 < id2.
PAIR_BASE = 2**31 - 1
