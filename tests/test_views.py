import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.operators import views as vw

K = [10.0, 0.0, 5.0, 0.0, 10.0, 1.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def views(spark):
    z = np.arange(64, dtype="<f4").reshape(4, 16)
    image = np.stack([z, z + 1, 255 - z], -1).astype(np.uint8)
    rows = [(1, 4, 16, K, bytearray(z.tobytes()), bytearray(image.tobytes()), 7), (2, 4, 16, K, bytearray(b"short"), None, 7), (3, None, 16, None, None, None, None)]
    return spark.createDataFrame(rows, "id int, h int, w int, k array<double>, data binary, image binary, top int")


def pixels(r, image=False):
    return np.frombuffer(r.image, np.uint8).reshape(r.h, r.w, 3) if image else np.frombuffer(r.data, "<f4").reshape(r.h, r.w)


def test_images_go_with_their_depth(views):
    for out in (vw.upright(views, F.lit(6)), vw.turned(views, F.lit(True))):
        r = out.where("id = 1").first()
        z = pixels(r)
        assert (r.h, r.w, r.top) == (16, 4, 7) and (z == np.rot90(np.arange(64).reshape(4, 16), -1)).all()
        assert (pixels(r, True)[..., 0] == z).all() and (pixels(r, True)[..., 2] == 255 - z).all()


def test_pads_are_white_and_empty(views):
    r = vw.padded(views).where("id = 1").first()
    assert (r.h, r.w) == (16, 16) and pixels(r)[:6].sum() == 0 and (pixels(r, True)[:6] == 255).all() and r.k[5] == 7.0
    assert (pixels(r)[6:10] == np.arange(64).reshape(4, 16)).all()


def test_whole_chain_and_views_that_cannot_be_read(views):
    out = {r.id: r for r in vw.prepared(views, 6, 6, orientation=F.lit(None).cast("int")).collect()}
    assert (out[1].h, out[1].w) == (6, 6) and pixels(out[1]).shape == (6, 6) and pixels(out[1], True).shape == (6, 6, 3)
    assert out[2].data is None and out[2].image is None and out[3].data is None
    small = vw.cropped(views, F.lit(99), F.lit(99)).where("id = 1").first()
    assert small.data is None
    assert vw.prepared(views.limit(0), 6, 6).collect() == []
