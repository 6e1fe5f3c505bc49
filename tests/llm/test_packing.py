import random

import pytest

from viewgraph.llm.packing import fill, pack, unused


def boxes(rows):
    held = {}
    for _, box, _, _, _, n in rows:
        held[box] = held.get(box, 0) + n
    return held


@pytest.mark.parametrize("most", [1, 8, 4096])
def test_nothing_is_lost_or_overfull(most):
    rng = random.Random(most)
    sizes = [rng.choice([0, 1, 99, 100, 101, 250, rng.randrange(1, 100)]) for _ in range(800)]
    rows = fill(sizes, 100, most)
    assert all(n <= 100 for n in boxes(rows).values())
    for i, size in enumerate(sizes):
        mine = sorted((p, first, n) for j, _, p, _, first, n in rows if j == i)
        assert sum(n for _, _, n in mine) == size and len(mine) == max(1, -(-size // 100))
        assert [f for _, f, _ in mine] == [100 * p for p, _, _ in mine]


def test_best_fit_takes_the_fullest_and_bounded_space_closes_it():
    # 60 and 70 are open; 30 goes to the fuller one.
    assert [r[1] for r in fill([60, 70, 30], 100)] == [1, 2, 2]
    # With one open container the second item closes the first.
    assert [r[1] for r in fill([60, 70, 40], 100, 1)] == [1, 2, 3]


def test_pack(spark):
    docs = [(1, "x" * 250), (2, "é" * 10), (3, ""), (4, None), (5, "y" * 40), (None, "z"), (5, "y" * 40), (6, "w" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS kind", "1 AS item")
    kinds = spark.createDataFrame([("small", 100), ("large", 1000), ("small", 100), ("bad", 0), ("none", None)], "k string, c int")
    out = pack(df, "doc_id", "text", kinds, "k", "c").collect()
    small = [r for r in out if r.kind == "small"]
    assert {r.kind for r in out} == {"small", "large"} and len(small) == 10
    assert sorted(r.n_tokens for r in small if r.item == 1) == [50, 100, 100] and {r.n_pieces for r in small if r.item == 1} == {3}
    assert [r.n_tokens for r in small if r.item == 2] == [20]
    assert [r.n_tokens for r in small if r.item in (3, 4)] == [0, 0] and sum(r.item is None for r in small) == 1
    again = pack(df.repartition(7), "doc_id", "text", kinds, "k", "c").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert pack(df.limit(0), "doc_id", "text", kinds, "k", "c").collect() == []
    assert pack(df, "doc_id", "text", kinds.limit(0), "k", "c").collect() == []
    got = {r.kind: r.tokens for r in unused(pack(df, "doc_id", "text", kinds, "k", "c"), kinds, "k", "c").collect()}
    assert got == {"small": 451, "large": 451}


def test_streams_are_bounded(spark):
    df = spark.range(3000).selectExpr("id", "repeat('a', int(id % 90)) AS text")
    kinds = spark.createDataFrame([("k", 100)], "k string, c int")
    out = pack(df, "id", "text", kinds, "k", "c", stream_items=500)
    assert out.selectExpr("substring_index(container, '-', 2) AS s").distinct().count() == 6
    assert unused(out, kinds, "k", "c").first().unused < 0.05


def test_a_long_stream_leaves_little_room(spark):
    """More large items than containers may be open: those must not be closed before small items come."""
    df = spark.range(30_000).selectExpr("id", "repeat('a', int(200 + pmod(xxhash64(id), 1500))) AS text")
    kinds = spark.createDataFrame([("k", 2048)], "k string, c int")
    assert unused(pack(df, "id", "text", kinds, "k", "c"), kinds, "k", "c").first().unused < 0.005
