import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from viewgraph.llm.cooccur import BLOCK, at_least_times_chance, cooccurrence
from viewgraph.llm.overlap import expand, needed_grams, overlaps, photo_of


def brute(rows, threshold):
    ok = [(i, s, set(w)) for i, s, w in rows if i is not None and w]
    out = set()
    for (a, s, x), (b, t, y) in product(ok, ok):
        if s in ("val", "test") and t == "train" and len(x & y) >= threshold * len(x | y) - 1e-12:
            out.add((a, b))
    return out


def near_sets(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["hot1", "hot2", "hot3"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = list(rng.choice(rows)[2])
            for _ in range(rng.randrange(3)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(rng.choice(words))
        else:
            base = rng.sample(words, rng.choice([1, 1, 2, 3, 5, 10, 24])) + ["hot1", "hot2"] * rng.randrange(2)
        rows.append((i, rng.choice(["train", "train", "val", "test", None]), base))
    return rows


@pytest.mark.parametrize(("threshold", "most"), [(0.8, None), (0.6, None), (1.0, None), (0.8, 0)])
def test_all_near_sets_are_found(spark, monkeypatch, threshold, most):
    if most is not None:  # nothing is broadcast
        monkeypatch.setattr("viewgraph.llm.overlap.BROADCAST_NAMES", most)
        monkeypatch.setattr("viewgraph.llm.overlap.BROADCAST_ROWS", most)
    rows = near_sets(int(threshold * 10), 150)
    df = spark.createDataFrame(rows, "id long, split string, words array<string>").withColumn("class_id", F.lit(1)).withColumn("n", F.lit(1))
    got = {(r.record_eval, r.record_train) for r in expand(*overlaps(df, "id", "split", F.col("words"), threshold=threshold)).collect()}
    assert got == brute(rows, threshold) and got


def test_grams_that_must_be_shared_are_shared():
    rng = random.Random(1)
    for _ in range(3000):
        c = rng.randrange(2, 40)
        a = c + rng.randrange(0, max(1, c // 4) + 1)
        if c / a < 0.8:
            continue
        b = c + rng.randrange(0, int(c / 0.8 + c - a) - c + 1)
        universe = list(range(a + b))
        rng.shuffle(universe)
        x, y = sorted(universe[:a]), sorted(universe[:c] + universe[a : a + b - c])
        common = set(zip(x, x[1:])) & set(zip(y, y[1:]))
        assert len(common) >= max(needed_grams(a, 0.8), needed_grams(b, 0.8))


def test_overlaps_edge_cases(spark):
    rows = [(1, "train", ["a", "a", None]), (2, "val", ["a"]), (3, "val", []), (4, "test", None), (None, "val", ["a"]), (2, "val", ["a"]), (5, None, ["a"]), (6, "other", ["a"])]
    df = spark.createDataFrame(rows, "id long, split string, words array<string>")
    assert {(r.record_eval, r.record_train) for r in expand(*overlaps(df, "id", "split", F.col("words"))).collect()} == {(2, 1)}
    assert expand(*overlaps(df.limit(0), "id", "split", F.col("words"))).collect() == []
    with pytest.raises(ValueError):
        overlaps(df, "id", "split", F.col("words"), threshold=0.5)
    got = spark.createDataFrame([("set 2/A b.JPG",), ("x/y/Ü.jpg",), ("",)], "k string").select(photo_of(F.col("k")).alias("p")).collect()
    assert [r.p for r in got] == ["a_b.jpg", "ü.jpg", ""]


def count_pairs(rows):
    sets = {}
    for g, i, items in rows:
        if i is not None and items:
            sets.setdefault((g, i), set()).update(x for x in items if x is not None)
    one, two, n = {}, {}, {}
    for (g, _), s in sets.items():
        if s:
            n[g] = n.get(g, 0) + 1
        for a in s:
            one[g, a] = one.get((g, a), 0) + 1
            for b in s:
                if a < b:
                    two[g, a, b] = two.get((g, a, b), 0) + 1
    return {(g, a, b, k, one[g, a], one[g, b], n[g]) for (g, a, b), k in two.items()}


def test_cooccurrence_counts(spark):
    rng = random.Random(3)
    rows = [("g", i, [rng.randrange(30) for _ in range(rng.randrange(6))]) for i in range(200)]
    rows += rows[:20] + [("g", 5, [100, 101]), ("h", 1, [1, None, 2]), ("h", 2, None), ("h", None, [1, 2]), ("h", 3, [1, 2])]
    rows += [("long", 1, list(range(2 * BLOCK + 5))), ("long", 2, list(range(10)))]
    df = spark.createDataFrame(rows, "scene string, id long, items array<int>").withColumn("weight", F.lit(9)).withColumn("n", F.lit(1))
    out = cooccurrence(df, "id", "items", ("scene",)).collect()
    assert {(r.scene, r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n) for r in out} == count_pairs(rows)
    r = next(x for x in out if x.scene == "h")
    assert r.lift == 1.0 and r.conviction is None
    assert cooccurrence(df.limit(0), "id", "items", ("scene",)).collect() == []
    assert {(r.item_a, r.item_b, r.n_ab) for r in cooccurrence(df.where("scene = 'h'"), "id", "items").collect()} == {(1, 2, 2)}


def test_counts_of_billions_are_compared_exactly(spark):
    big = 4_000_000_000
    rows = [(big, big, big, big), (big, big, big, 2 * big), (big // 2, big, big, big), (big, big, big, 2 * big - 1)]
    df = spark.createDataFrame(rows, "n_ab long, n_a long, n_b long, n long")
    assert [r[0] for r in df.select(at_least_times_chance(2)).collect()] == [False, True, False, False]
