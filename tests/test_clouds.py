import numpy as np
import pytest

from viewgraph.operators import clouds, nearest, registration
from viewgraph.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    xyz = {("s", "0", i): rng.uniform(0, 4, 3) for i in range(1, 30)} | {("odd", "0", i): rng.uniform(0, 4, 3) for i in range(1, 18, 2)}
    at = tmp_path_factory.mktemp("clouds")
    rows = [(*k, v.tolist()) for k, v in xyz.items()]
    spark.createDataFrame(rows, "scene string, recon string, point3d_id long, xyz array<double>").write.parquet(str(at / "point3d.parquet"))
    return str(at), xyz


def _brute(xyz):
    """(scene, recon, idx): (nearest true point, distance) of every point moved as the queries do."""
    out = {}
    for k, v in xyz.items():
        p = v * 1.01 + [0.02, -0.03, 0] + [(k[2] * n % 101) / 1000 - 0.05 for n in (37, 59, 83)]
        out[k] = min((float(np.linalg.norm(p - w)), m[2]) for m, w in xyz.items() if m[:2] == k[:2])
    return out


def test_clouds_ask_and_search_every_point(spark, folder):
    at, xyz = folder
    want = _brute(xyz)
    got = {(r.scene, r.recon, r.idx): (r.distance, r.nn) for r in registry.queries()["nearest_points"](spark, at).collect()}
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-6) for k in want)
    fit = {r.scene: r.s for r in registry.queries()["similarity_fit"](spark, at).where("s is not null").collect()}
    assert set(fit) == {"s"} and fit["s"] == pytest.approx(1 / 1.01, abs=0.02)
    moments = {r.scene: r.n for r in registry.queries()["similarity_moments"](spark, at).collect()}
    assert moments == {"s": 29.0, "odd": 9.0}


def test_nearest_needs_no_cell_and_takes_dense_and_distant_points(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(size=(50, 3)), [[1e7, 0, 0], [0.5, 0.5, 0.5]]])
    b = np.concatenate([rng.normal(size=(40, 3)), np.tile([[0.5, 0.5, 0.5]], (30, 1))])
    frame = lambda p: spark.createDataFrame([("g", i, *map(float, v)) for i, v in enumerate(p)] + [("g", 999, float("nan"), 0.0, 0.0), ("g", 998, None, 0.0, 0.0)], "k string, idx long, x double, y double, z double")
    got = {r.idx: (r.nn, r.distance) for r in nearest.nearest(frame(a), frame(b), ["k"]).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=-1)
    assert len(got) == len(a) and all(got[i] == (d[i].argmin(), pytest.approx(d[i].min())) for i in range(len(a)))
    near = {r.idx for r in nearest.nearest(frame(a), frame(b), ["k"], radius=0.7).collect()}
    assert near == {i for i in range(len(a)) if d[i].min() <= 0.7}


@pytest.mark.parametrize("name", ["cloud_accuracy", "mutual_points", "normal_consistency"])
def test_clouds_are_compared_without_tables_or_broadcasts_of_points(spark, folder, monkeypatch, name):
    made = []
    write, broadcast = nearest.Workspace.write, nearest.F.broadcast
    monkeypatch.setattr(nearest.Workspace, "write", lambda *a, **k: made.append("table") or write(*a, **k))
    monkeypatch.setattr(nearest.F, "broadcast", lambda df: made.append("broadcast") or broadcast(df))
    assert registry.queries()[name](spark, folder[0]).count() > 0
    assert not made


def test_large_and_small_groups_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = lambda n, groups: [(k, i % 97, *map(float, v)) for k in groups for i, v in enumerate(rng.integers(0, 5, (n, 3)))]
    schema = "k string, idx long, x double, y double, z double"
    a = spark.createDataFrame([*rows(120, "ab"), *rows(20, "c"), ("d", 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)], schema)
    b = spark.createDataFrame([*rows(110, "ab"), *rows(10, "c"), ("e", 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)], schema)
    got = lambda: [{(r.k, r.idx): (r.nn, r.distance) for r in side.collect()} for side in nearest.nearest_both(a, b, ["k"])]
    whole = got()
    monkeypatch.setattr(clouds, "WHOLE_ROWS", 100)
    assert got() == whole and [len(w) for w in whole] == [97 * 2 + 20, 97 * 2 + 10]
    p, q = a.toPandas(), b.toPandas()
    for w, x, y in ((whole[0], p, q), (whole[1], q, p)):
        pairs = x.dropna().merge(y.dropna(), on="k")
        pairs["d"] = np.sqrt((pairs.x_x - pairs.x_y) ** 2 + (pairs.y_x - pairs.y_y) ** 2 + (pairs.z_x - pairs.z_y) ** 2)
        first = pairs.sort_values(["d", "idx_y"]).drop_duplicates(["k", "idx_x"])
        assert w == {(r.k, r.idx_x): (r.idx_y, r.d) for r in first.itertuples()}


def test_mutual_points_are_paired_without_joins_or_folds(spark, folder):
    out = registry.queries()["mutual_points"](spark, folder[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    assert out.count() > 0


def test_mutual_neighbours_are_those_of_both_directions(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = lambda n, groups, m: [(k, i % m, *map(float, v)) for k in groups for i, v in enumerate(rng.integers(0, 6, (n, 3)))]
    schema = "k string, idx long, x double, y double, z double"
    a = spark.createDataFrame([*rows(120, "ab", 97), *rows(20, "c", 30), *rows(700, "f", 900), ("d", 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), ("g", None, 0.0, 0.0, 0.0), ("g", 1, 9.0, 9.0, 9.0)], schema)
    b = spark.createDataFrame([*rows(110, "ab", 97), *rows(10, "c", 30), *rows(600, "f", 900), ("e", 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), ("g", 5, 0.0, 0.0, 0.0), ("g", 6, 9.0, 9.0, 8.0)], schema)
    got = lambda df: sorted((r.k, r.a, r.b, r.distance) for r in df.collect())
    want = got(nearest.mutual(*nearest.nearest_both(a, b, ["k"]), ["k"]))
    mutual = lambda radius=None: got(nearest.nearest_mutual(a, b, ["k"], radius))
    assert {r[0] for r in want} == set("abcfg") and mutual() == want
    assert mutual(1.0) == [r for r in want if r[3] <= 1] != want
    repeated = nearest.nearest_mutual(a.unionAll(a), b.unionAll(b), ["k"])
    assert got(repeated) == want
    monkeypatch.setattr(clouds, "WHOLE_ROWS", 100)
    assert mutual() == want


def test_both_directions_share_distances(spark):
    rng = np.random.default_rng(10)
    for n, m in ((1, 1), (1, 300), (300, 1), (90, 80), (450, 500), (600, 700)):
        p, q = (rng.integers(0, 5, (k, 3)).astype(float) for k in (n, m))
        for got, want in zip(clouds.near_both(p, q), (clouds.near(p, q), clouds.near(q, p))):
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    far = np.array([[1e200, 0, 0], [-1e200, 0, 0]])
    assert [x.tolist() for x in clouds.near_both(far, far[::-1])[1]] == [[1, 0], [0.0, 0.0]]


@pytest.mark.parametrize("name", ["cloud_accuracy", "normal_consistency"])
def test_summaries_of_clouds_shuffle_no_points_to_fold_repeated_rows(spark, folder, tmp_path, name):
    out = registry.queries()[name](spark, folder[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and ("xyz" in line or "idx" in line)]
    rows = spark.read.parquet(f"{folder[0]}/point3d.parquet")
    rows.unionAll(rows.where("point3d_id % 3 = 0")).write.parquet(str(tmp_path / "point3d.parquet"))
    assert sorted(registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(out.collect())


def test_the_tree_is_exact_for_ties_dense_and_distant_points():
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.integers(0, 6, (900, 3)), rng.normal(size=(300, 3)) * 1e-6, [[1e9, 0, 0]], np.zeros((400, 3))]).astype(float)
    q = np.concatenate([rng.uniform(-1, 7, (500, 3)), rng.integers(0, 6, (300, 3)), [[-1e8, 5, 5]]]).astype(float)
    at, d = clouds.Tree(p).near(q)
    every = clouds._distances(q, p)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()


def test_normals_are_those_of_the_nearest_points(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(size=(60, 3)) * [3, 3, 0.05], [[40, 1, 0]]])
    rows = [("g", i, *map(float, v)) for i, v in enumerate(p)] + [("two", 1, 0.0, 0.0, 0.0), ("two", 2, 1.0, 0.0, 0.0), ("g", 99, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, idx long, x double, y double, z double")
    got = {(r.k, r.idx): np.array([r.nx, r.ny, r.nz]) for r in registration.normals(df, ["k"], 8).collect()}
    assert len(got) == 63 and all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())
    for i in range(61):
        near = p[np.argsort(((p - p[i]) ** 2).sum(1), kind="stable")[:8]]
        want = np.linalg.eigh(np.cov(near.T))[1][:, 0]
        assert abs(want @ got["g", i]) == pytest.approx(1, abs=1e-6)
    assert registration.normals(df.limit(0), ["k"]).collect() == []


def test_every_sequence_has_a_residual(spark, folder):
    got = {r.scene: r.residual for r in registry.queries()["icp_residual"](spark, folder[0]).collect()}
    assert set(got) == {"s", "odd"}


def test_icp_of_a_group_does_not_depend_on_others(spark):
    rng = np.random.default_rng(1)
    small, large = rng.uniform(0, 3, (30, 3)), rng.uniform(0, 3, (900, 3))
    c, s = np.cos(0.4), np.sin(0.4)
    turned = small @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) + [0.3, -0.15, 0.15]
    frame = lambda parts: spark.createDataFrame([(k, i, *map(float, v)) for k, p in parts for i, v in enumerate(p)], "seq string, idx long, x double, y double, z double")
    run = lambda source, target: {r.idx: (r.x, r.y, r.z) for r in registration.icp(frame(source), frame(target), ["seq"], 1.0, 12, tolerance=5e-3).where("seq = 'small'").collect()}
    alone = run([("small", turned)], [("small", small)])
    beside = run([("small", turned), ("large", large)], [("small", small), ("large", large)])
    assert set(alone) == set(beside) == set(range(30))
    assert all(np.allclose(alone[i], beside[i], atol=1e-9) for i in alone)
    assert not np.allclose([alone[i] for i in range(30)], turned, atol=0.05)


def test_icp_of_whole_groups_is_that_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p = {k: rng.uniform(0, 2, (n, 3)) for k, n in (("a", 40), ("b", 600))}
    schema = "seq string, idx long, x double, y double, z double"
    target = spark.createDataFrame([(k, i, *map(float, v)) for k in p for i, v in enumerate(p[k])], schema)
    source = spark.createDataFrame([(k, i, *map(float, v)) for k in p for i, v in enumerate(p[k] * 1.01 + 0.02)] + [("a", 900, None, 1.0, 2.0)], schema)
    run = lambda: {(r.seq, r.idx): (r.x, r.y, r.z) for r in registration.icp(source, target, ["seq"], 0.3, 4).where("x is not null").collect()}
    with monkeypatch.context() as m:
        m.setattr(registration.Workspace, "write", lambda *a, **k: pytest.fail("a table was written"))
        whole = run()
        assert registration.icp(source, target, ["seq"], 0.3, 4).count() == 641
    monkeypatch.setattr(clouds, "WHOLE_ROWS", 10)
    joined = run()
    assert set(whole) == set(joined) and len(whole) == 640
    assert all(np.allclose(whole[i], joined[i], atol=1e-9) for i in whole)


def test_icp_leaves_groups_without_neighbours(spark):
    a = spark.createDataFrame([("far", 1, 50.0, 0.0, 0.0), ("none", 1, 0.0, 0.0, 0.0)], "seq string, idx long, x double, y double, z double")
    b = spark.createDataFrame([("far", 1, 0.0, 0.0, 0.0)], a.schema)
    assert {(r.seq, r.x) for r in registration.icp(a, b, ["seq"], 1.0, 3).collect()} == {("far", 50.0), ("none", 0.0)}


def test_the_residual_is_that_of_the_default_icp(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(registration, "icp", lambda source, target, keys, *a, **k: asked.append((a, k)) or source)
    registry.queries()["icp_residual"](spark, folder[0])
    assert asked == [((), {})]
