from viewgraph.operators import clusters, samplers
from viewgraph.plans import depth, graphs


def test_scene_samples_takes_the_samplers_defaults(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graphs, "match_graph", lambda *a: "edges")
    monkeypatch.setattr(samplers, "scene_samples", lambda *a, **k: asked.append((a, k)))
    graphs.scene_samples(spark, "folder")
    assert asked == [(("edges", graphs.KEYS), {"weight": "weight"})]


def test_skeletal_clusters_come_from_a_connected_graph(spark, tmp_path, monkeypatch):
    near = lambda side, k: [1.0, 0.05 * k, 0.0] if side == 0 else [0.0, 0.05 * k, 1.0]
    rows = [(i, "a", near(i // 4, i % 4)) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = []
    monkeypatch.setattr(clusters, "clusters", lambda edges, *a, **k: seen.append(edges))
    graphs.skeletal_clusters(spark, str(tmp_path))
    parts = {i: {i} for i in range(8)}
    for r in seen[0].collect():
        both = parts[r.src] | parts[r.dst]
        parts |= dict.fromkeys(both, both)
    assert parts[0] == set(range(8))


def test_events_are_those_of_the_two_least_types(spark, monkeypatch):
    rows = [("u", i, f"t{i:04}", float(i), 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq string, event_id long, event_type string, us double, value double")
    monkeypatch.setattr(depth, "_walk", lambda *a: df)
    assert [tuple(r) for r in depth.asof_events(spark, "folder").collect()] == [("u", 0, 1e-6)]
