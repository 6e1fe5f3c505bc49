import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.operators import components as cc
from viewgraph.operators import graph as gr
from viewgraph.operators import samplers as sm
from viewgraph.operators.clusters import clusters
from viewgraph.operators.walks import spread_walks

K = ["scene"]


def test_pair_ids(spark):
    top = 2**31 - 2
    df = spark.createDataFrame([(1, 2), (2, 1), (top, top - 1), (5, top)], "a int, b int").select("a", "b", gr.pair_id(F.col("a"), F.col("b")).alias("p"))
    x, y = gr.pair_images(F.col("p"))
    for r in df.select("a", "b", x.alias("x"), y.alias("y")).collect():
        assert (r.x, r.y) == (min(r.a, r.b), max(r.a, r.b))


def test_build_graph_takes_the_last_count_over_sixteen(spark):
    rows = [("s", "a", "b", 17, 1), ("s", "b", "a", 40, 2), ("s", "a", "c", 16, 1), ("s", "a", "d", None, 1), ("s", "e", "e", 99, 1), ("s", None, "e", 99, 1)]
    df = spark.createDataFrame(rows, "scene string, src string, dst string, matches_num long, at int")
    assert [tuple(r) for r in gr.build_graph(df, ["at"], K).collect()] == [("s", "a", "b", 40)]


def test_co_observation_and_the_minus_one_rule(spark):
    rows = [("s", i, p) for i in (1, 2) for p in range(5)] + [("s", 1, -1), ("s", 2, None), ("s", 1, 0), ("s", 3, 4)]
    df = spark.createDataFrame(rows, "scene string, image int, point long")
    assert {tuple(r) for r in gr.co_observation(df, K, "image", "point").collect()} == {("s", 1, 2, 5), ("s", 1, 3, 1), ("s", 2, 3, 1)}
    wanted = spark.createDataFrame([("s", 1, 3), ("s", 1, 9)], "scene string, src int, dst int")
    assert {tuple(r) for r in gr.co_observation(df, K, "image", "point", 1, wanted).collect()} == {("s", 1, 3, 1)}
    a = spark.createDataFrame([([1, 2, 2, -1], [2, 1, -1]), ([1, 2], [1, 2]), ([1], [2])], "a array<long>, b array<long>")
    assert [r[0] for r in a.select(gr.common_points(F.col("a"), F.col("b"))).collect()] == [2, 1, -1]


def test_components_forest_and_growth(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.random()) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.05] + [(i, i + 1, rng.random()) for i in range(50, 80)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    vertices = spark.range(90).select("id")
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tree = set()
    for w, a, b in sorted(((w, a, b) for a, b, w in edges), reverse=True):
        if find(a) != find(b):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
            tree.add((a, b))
    assert {r.id: r.component for r in cc.connected_components(vertices, df).collect()} == {i: find(i) for i in range(90)}
    assert {(r.src, r.dst) for r in cc.spanning_forest(vertices, df).collect()} == tree
    assert cc.spanning_forest(vertices, df.limit(0)).collect() == []
    grown = {(r.center, r.id): r.strength for r in cc.growth(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (1, 5, 0.1), (1, 3, 0.5)], "src long, dst long, weight double"), 0.4, 2).collect()}
    assert set(grown) == {(1, 1), (1, 2), (1, 3), (1, 4)} and grown[1, 3] == pytest.approx(0.81)


@pytest.mark.parametrize("task_links", [0, 40, 200_000])
def test_components_of_chains_and_hubs(spark, monkeypatch, task_links):
    monkeypatch.setattr(cc, "TASK_LINKS", task_links)
    rng = random.Random(4)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)] + [(f"h{i:03}", "hub") for i in range(60)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    want: dict[str, set] = {}
    for a, b in links:
        both = want.get(a, {a}) | want.get(b, {b})
        want |= dict.fromkeys(both, both)
    df = spark.createDataFrame([*links, (None, "x")], "src string, dst string")
    got = {r.id: r.component for r in cc.connected_components(spark.createDataFrame([("alone",), (None,)], "id string"), df).collect()}
    assert got == {a: min(v) for a, v in want.items()} | {"alone": "alone"}


def ring(n, extra=0, seed=0):
    rng = random.Random(seed)
    rows = [(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)] + [(f"n{a:03}", f"n{b:03}") for a, b in (rng.sample(range(n), 2) for _ in range(extra))]
    return [(min(a, b), max(a, b), 50 + rng.randrange(50), rng.random()) for a, b in rows]


def as_graph(rows):
    g = {}
    for a, b, w, d in rows:
        g.setdefault(a, {})[b] = (w, d)
        g.setdefault(b, {})[a] = (w, d)
    return {n: dict(sorted(g[n].items())) for n in sorted(g)}


def test_louvain_finds_cliques():
    rows = [(f"{c}{i}", f"{c}{j}", 1.0, 1.0) for c in "abc" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0, 1.0), ("b1", "c1", 1.0, 1.0)]
    g = as_graph(rows)
    found = sm.louvain(g)
    assert len(set(found.values())) == 3 and all(len({found[f"{c}{i}"] for i in range(5)}) == 1 for c in "abc")
    assert sm.modularity(g, found) > 0.5


def test_steiner_tree_spans_at_most_twice_the_least():
    g = as_graph([("a", "x", 1, 1), ("b", "x", 1, 1), ("c", "x", 1, 1), ("a", "b", 3, 1), ("b", "c", 3, 1)])
    assert sm.steiner_tree(g, ["a", "b", "c"]) == ["a", "b", "c", "x"]
    assert sm.steiner_tree(g, ["a"]) == ["a"]


def test_samples_have_exactly_n_connected_nodes():
    g = as_graph(ring(60, 40))
    community = sm.louvain(g)
    for seed in range(12):
        got = sm.partitioned_sample(g, community, sm.generator(seed, "s"), 24, 1 + seed % 4, 10, 40, 8)
        if got is not None:
            assert len(got) == len(set(got)) == 24 and set(got) <= set(g) and len(sm.components(g, got)) == 1
            assert got == sm.partitioned_sample(g, community, sm.generator(seed, "s"), 24, 1 + seed % 4, 10, 40, 8)
    assert sm.partitioned_sample(as_graph(ring(10)), {}, sm.generator(0), 24) is None


def test_quotas_and_depth_first():
    for sizes, n in (([10, 10, 10], 24), ([100, 3, 2], 24), ([5, 4], 30), ([2] * 20, 24)):
        q = sm.quotas(sizes, n)
        assert sum(q) == min(n, sum(sizes)) and all(0 <= a <= s for a, s in zip(q, sizes))
    g = as_graph(ring(8) + [("z1", "z2", 1, 1)])
    assert len(sm.dfs_over_components(g, 6, sm.generator(1))) == 6
    with pytest.raises(ValueError):
        sm.dfs_over_components(g, 99, sm.generator(1))
    tree = sm.max_leaf_tree(g)
    assert len(tree) == 7 and len({b for _, b in tree}) == 7


def grown(g, tau, window, centers):
    """Clusters by trying all walks of at most `window` edges."""
    out = {}
    for c in centers:
        best, front = {c: 1.0}, {c: 1.0}
        for _ in range(window):
            step = {}
            for a, s in front.items():
                for b, (w, _) in g[a].items():
                    if s * w >= tau and s * w > max(best.get(b, 0), step.get(b, 0)):
                        step[b] = s * w
            best.update(step)
            front = step
        out[c] = set(best)
    return out


@pytest.mark.parametrize(("tau", "most"), [(0.5, None), (0.95, None), (0.6, 3)])
def test_clusters_are_what_their_centres_reach(spark, tau, most):
    rows = [*{(a, b): (a, b, w / 100, d) for a, b, w, d in ring(20, 5, 3)}.values(), ("y1", "y2", 0.7, 1.0)]
    g = as_graph(rows)
    df = spark.createDataFrame([("s", *r) for r in rows] + [("t", "n001", "n002", 0.9, 1.0), ("t", None, "n002", 0.9, 1.0)], "scene string, src string, dst string, weight double, distance double")
    got = {}
    for r in clusters(df, K, tau=tau, window=2, min_weight=0.0, overlap=False, most=most).collect():
        got.setdefault((r.scene, r.cluster), set()).add(r.id)
    assert got["t", "n001"] == ({"n001", "n002"} if tau <= 0.9 or most else {"n001"})
    mine = {c: v for (s, c), v in got.items() if s == "s"}
    if most is None:
        assert mine == grown(g, tau, 2, list(g))
    else:
        centers = sorted(g, key=lambda a: (-len(g[a]), a))[:most]
        assert all(mine[c] >= v for c, v in grown(g, tau, 2, centers).items()) and set().union(*mine.values()) == set(g)
    over = {}
    for r in clusters(df, K, tau=tau, window=2, min_weight=0.0, most=most).where("scene = 's'").collect():
        over.setdefault(r.cluster, set()).add(r.id)
    assert all(any(v & o for k, o in over.items() if k != c) for c, v in over.items() if any(b not in v for a in v for b in g[a]))
    assert clusters(df.limit(0), K).collect() == []


def test_walks_spread_over_communities():
    g = as_graph([(f"{c}{i}", f"{c}{j}", 1.0, 0.1) for c in "abcd" for i in range(6) for j in range(i + 1, 6)] + [(f"{c}0", f"{e}0", 1.0, 1.0) for c in "abcd" for e in "abcd" if c < e])
    community = {a: "abcd".index(a[0]) for a in g}
    for branching in (False, True):
        walks = spread_walks(g, 8, community, np.random.default_rng(1), trials=64, top_k=5, branching=branching)
        assert walks == spread_walks(g, 8, community, np.random.default_rng(1), trials=64, top_k=5, branching=branching) and len(walks) == 5
        for w in walks:
            assert len(w) == len(set(w)) and {a[0] for a in w} == set("abcd")
            assert all(any(b in g[a] for a in w[:i]) for i, b in enumerate(w) if i)
    assert spread_walks(g, 99, community, np.random.default_rng(1)) == [list(g)]


def test_scene_samples_do_not_depend_on_partitions(spark):
    rows = [("s", *r) for r in ring(40, 30)] + [("t", *r) for r in ring(8)]
    df = spark.createDataFrame(rows, "scene string, src string, dst string, common_pts long, distance double")
    a = sm.scene_samples(df, K, 12, 3, trials=8, top_k=2)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, sm.scene_samples(df.repartition(7), K, 12, 3, trials=8, top_k=2).collect()))
    assert {r[1] for r in got} <= {0, 1, 2} and {r[0] for r in got} == {"s"} and {sum(1 for r in got if r[1] == c) for c in {r[1] for r in got}} == {12}
    mask = sm.neighbour_mask(a.where("case = 0"), df, K).collect()
    assert len(mask) == 144 and all(r.linked for r in mask if r.i == r.j)


def test_similarities(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, "g", rng.normal(size=8).tolist()) for i in range(30)] + [(99, "g", None)], "id long, k string, v array<double>")
    from viewgraph.operators.nearest import knn

    got = {(r.id, r.neighbour) for r in knn(df, "id", "v", 2, 7).collect()}
    v = np.array([r.v for r in df.where("v is not null").orderBy("id").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(i, int(j)) for i in range(30) for j in np.argsort(-s[i])[:2]}
    top = gr.strongest(gr.all_similarities(df.where("v is not null"), ["k"], "id", "v"), ["k"], 1).collect()
    assert {(r.src, r.dst) for r in top} == {tuple(sorted((i, int(s[i].argmax())))) for i in range(30)}
