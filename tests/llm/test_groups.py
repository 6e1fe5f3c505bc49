import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.llm import queries as llm
from viewgraph.llm.consolidate import consolidate, least_of_components
from viewgraph.llm.splits import assign_splits, greedy_shares, related_groups, union_find
from viewgraph.scale import Workspace


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def random_links(seed):
    rng = random.Random(seed)
    hub = [("s", f"h{i:03}", "hub") for i in range(60)]
    chain = [("s", f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    rest = [(rng.choice("st"), f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    links = hub + chain + rest + rest[:10] + [(s, b, a) for s, a, b in rest[:10]]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize(("much", "task_links"), [(0, 1), (0, 10**6), (10**9, 10**6), (20, 30)])
def test_groups_equal_union_find_for_every_depth_of_peeling(spark, monkeypatch, much, task_links):
    monkeypatch.setattr("viewgraph.llm.consolidate.MUCH", much)  # 0: one round, 10**9: until nothing is reached
    links = random_links(much % 7)
    df = spark.createDataFrame(links, "scene string, src string, dst string").withColumn("name", F.lit("clash")).withColumn("id", F.lit(7))
    want = set()
    for scene in "st":
        want |= {(scene, n, g) for n, g in brute([(a, b) for s, a, b in links if s == scene and a != b]).items()}
    assert {tuple(r) for r in consolidate(df, graph_cols=("scene",), task_links=task_links).collect()} == want


def test_least_of_components_of_long_chains():
    rng = np.random.default_rng(3)
    name = rng.permutation(5000)
    src, dst = name[:-1][np.arange(4999) % 100 != 99], name[1:][np.arange(4999) % 100 != 99]
    ids, roots = least_of_components(src, dst)
    want = brute(zip(src.tolist(), dst.tolist()))
    assert dict(zip(ids.tolist(), roots.tolist())) == want


def test_consolidate_ignores_nulls_and_loops_and_keeps_null_graphs(spark):
    rows = [("s", "a", None), ("s", None, "b"), ("s", "c", "c"), (None, "x", "y"), (None, "y", "z"), ("s", "y", "z"), ("s", "", "z")]
    df = spark.createDataFrame(rows, "scene string, src string, dst string")
    got = {tuple(r) for r in consolidate(df, graph_cols=("scene",)).collect()}
    assert got == {(None, "x", "x"), (None, "y", "x"), (None, "z", "x"), ("s", "y", ""), ("s", "z", ""), ("s", "", "")}
    assert consolidate(df.limit(0), graph_cols=("scene",)).collect() == []
    assert {tuple(r) for r in consolidate(df.where("scene is null")).collect()} == {("x", "x"), ("y", "x"), ("z", "x")}


def test_union_find_over_many_levels(spark, monkeypatch):
    rng = random.Random(5)
    links = [(i + 1, i) for i in range(3000)] + [(5000 + rng.randrange(500), 5000 + rng.randrange(500)) for _ in range(400)]
    df = spark.createDataFrame(links, "src long, dst long").where("src <> dst")
    space = Workspace(spark, "uf")
    found = union_find(space, space.write(df), parts=64)
    assert {tuple(r) for r in found.df.collect()} == set(brute([x for x in links if x[0] != x[1]]).items())


def test_related_groups(spark):
    rows = [("a", "p1", "x"), ("b", "p1", None), ("c", None, "x"), ("d", None, None), ("d", None, None), (None, "p1", "z"), ("e", None, "z"), ("a", "p2", None), ("f", "p2", None)]
    df = spark.createDataFrame(rows, "name string, place string, who string")
    got = {tuple(r) for r in related_groups(df, "name", {"place": F.col("place"), "who": F.col("who")}).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("f", "a"), ("d", "d"), ("e", "e")}
    assert related_groups(df.limit(0), "name", {"place": F.col("place")}).collect() == []


def one_by_one(sizes, targets):
    total, whole = sum(s * c for s, c in sizes), sum(targets.values())
    lack = {k: v / whole * total for k, v in targets.items()}
    out = {k: {} for k in targets}
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            best = max(lack, key=lambda k: (lack[k], -list(lack).index(k)))
            lack[best] -= size
            out[best][size] = out[best].get(size, 0) + 1
    return out


def test_greedy_shares_equal_one_by_one():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [(s, rng.choice([1, 3, 2000, 5000])) for s in rng.sample(range(1, 60), 6)]
        targets = {"train": 0.8, "val": rng.random(), "test": 0.1}
        want = one_by_one(sizes, targets)
        got = {k: {} for k in targets}
        for size, split, a, b in greedy_shares(sizes, targets):
            got[split][size] = b - a
        assert sum(s * n for x in got.values() for s, n in x.items()) == sum(s * c for s, c in sizes)
        for k in targets:  # counts per split differ by ties at most
            assert abs(sum(s * n for s, n in got[k].items()) - sum(s * n for s, n in want[k].items())) <= max(s for s, _ in sizes)
    assert greedy_shares([], {"a": 1.0}) == [] and greedy_shares([(1, 1)], {}) == []


def test_assigned_splits_keep_groups_whole_and_near_the_targets(spark):
    rows = [(f"n{i:05}", f"g{i if i > 2000 else i % 7:05}") for i in range(6000)]
    out = assign_splits(spark.createDataFrame(rows, "name string, group_name string"), {"train": 0.7, "val": 0.2, "test": 0.1}).collect()
    assert len(out) == 6000 and len({(r.group_name, r.split) for r in out}) == len({r.group_name for r in out})
    share = {s: sum(r.split == s for r in out) / 6000 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.7) < 0.001 and abs(share["val"] - 0.2) < 0.001
    assert {r.split for r in assign_splits(spark.createDataFrame(rows[:3], "name string, group_name string"), {}).collect()} == {None}


def test_too_many_split_targets_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(llm, "_entries", lambda *a: (None, None))
    monkeypatch.setattr(llm, "table", lambda *a: spark.range(1001).selectExpr("string(id) AS split", "1.0D AS proportion"))
    monkeypatch.setattr(llm, "assign_splits", lambda *a: spark.createDataFrame([("a",)], "name string"))
    with pytest.raises(ValueError, match="1000"):
        llm.p4_splits(spark, "folder")
