import random

import numpy as np
import pytest

from viewgraph.llm.leaks import PassageIndex, leaked_passages, least_distances, myers
from viewgraph.llm.words import words_of


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        want = [min(edit(p, t[i : j + 1]) for i in range(j + 2)) for j in range(len(t))]
        assert myers(p, t) == want


def test_distances_of_many_rows_equal_those_of_one():
    rng = np.random.default_rng(2)
    p, t = rng.integers(1, 4, (300, 13)), rng.integers(0, 4, (300, 15))
    assert least_distances(p, t).tolist() == [min(myers(a, b)) for a, b in zip(p.tolist(), t.tolist())]


@pytest.mark.parametrize("n_items", [20, 400])
def test_a_line_that_all_items_share_proposes_only_what_matches(n_items):
    line = [f"licence{i}" for i in range(10)]
    items = [(i, [f"a{i}_{k}" for k in range(8)] + line + [f"b{i}_{k}" for k in range(8)]) for i in range(n_items)]
    index = PassageIndex(items, 13, 1)
    code = [index.vocabulary[w] for w in line] * 500
    gap = [0] * 20
    assert len(index.candidates(np.array(gap + code + gap))[0]) == 0
    one = [index.vocabulary[w] for w in items[3][1]]
    at, passage, errors = index.matches(np.array(gap + code + one + code + gap))
    assert 14 <= len(set(passage.tolist())) <= 20 and errors.min() == 0 and len(at) < 600


def test_items_with_equal_passages_are_put_to_them_at_the_end():
    text = [f"w{i}" for i in range(30)]
    index = PassageIndex([(i, text) for i in range(50)], 13, 1)
    assert len(index.patterns) == 18 and index.sizes.tolist() == [50]
    rows = index.leaks([7, 8], [text[3:20], ["no"] * 40])
    assert sorted(rows.column(0).to_pylist()) == list(range(50)) and set(rows.column(1).to_pylist()) == {7} and set(rows.column(2).to_pylist()) == {0}


def test_words():
    assert words_of("Foo_bar-BAZ 3.5\n x") == ["foo", "bar", "baz", "3", "5", "x"]
    assert words_of("运行280次abcカタ") == ["运", "行", "280", "次", "abc", "カ", "タ"]
    assert words_of("Straße é² हिन्दी") == ["straße", "é²", "ह", "न", "द"]
    assert words_of(None) == [] and words_of("") == [] and words_of("_!") == []


def has_run(doc, item, n=13):
    runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(doc[i : i + n]) in runs for i in range(len(doc) - n + 1))


def least_errors(doc, item, most, n=13):
    best = min((edit(item[s : s + n], doc[a:b]) for s in range(len(item) - n + 1) for a in range(len(doc)) for b in range(a + n - most, min(len(doc), a + n + most) + 1)), default=99)
    return best if best <= most else None


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_equal_brute_force(spark, errors):
    rng = random.Random(errors)
    words = [f"w{i}" for i in range(40)] + ["的", "日"]
    items = [(i, [rng.choice(words) for _ in range(rng.choice([5, 12, 13, 20, 25]))]) for i in range(8)]
    docs = []
    for d in range(60):
        _, base = rng.choice(items)
        a = rng.randrange(len(base))
        part = base[a : a + rng.randrange(9, 18)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(part) + 1)
            part = part[:k] + rng.choice([["new"], [], ["w1"]]) + part[k + rng.randrange(2) :]
        docs.append((d, [rng.choice(words) for _ in range(6)] + part + [rng.choice(words) for _ in range(6)]))
    text = lambda w: "  ".join(x.upper() if rng.random() < 0.5 else x for x in w).replace("  ", rng.choice([" ", "\n", "_"]))
    df = spark.createDataFrame([(d, text(w), 1) for d, w in docs], "doc_id long, text string, item int")
    it = spark.createDataFrame([(i, text(w), 1) for i, w in items], "item_id long, text string, doc int")
    got = {(r.item, r.doc): r.errors for r in leaked_passages(df, "doc_id", "text", it, "item_id", "text", max_errors=errors, block_words=rng.choice([1, 50, 10**6])).collect()}
    want = {(i, d): e for i, x in items for d, w in docs if (e := least_errors(w, x, errors)) is not None}
    assert {k: v for k, v in got.items() if v == 0} == {k: v for k, v in want.items() if v == 0}
    assert got == want


def test_portions_hold_all_documents():
    import pyarrow as pa

    from viewgraph.llm import leaks

    texts = ["x" * n for n in (5, leaks.PORTION_BYTES, 1, 2, leaks.PORTION_BYTES + 9, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["skip", *texts, "é"])], names=["d", "t"])
    out = list(leaks._portions(iter([batch.slice(1), batch.slice(0, 0)])))
    assert [i for ids, _ in out for i in ids] == [1, 2, 3, 4, 5, 6, 7] and [t for _, ts in out for t in ts] == [*texts, "é"]
    assert [len(ids) for ids, _ in out] == [1, 1, 2, 1, 2]


def test_leak_edge_cases(spark):
    item = " ".join(f"a{i}" for i in range(13))
    df = spark.createDataFrame([(1, item + "!"), (1, item), (2, None), (3, ""), (None, item), (4, "b " * 200_000 + item)], "d long, t string")
    it = spark.createDataFrame([(1, item), (2, item), (1, item), (3, ""), (4, None), (None, item), (5, "short one")], "i long, t string")
    got = {(r.item, r.doc) for r in leaked_passages(df, "d", "t", it, "i", "t").collect()}
    assert got == {(1, 1), (2, 1), (1, 4), (2, 4)}
    assert leaked_passages(df.limit(0), "d", "t", it, "i", "t").collect() == []
    assert leaked_passages(df, "d", "t", it.limit(0), "i", "t").collect() == []
    with pytest.raises(ValueError):
        leaked_passages(df, "d", "t", it, "i", "t", max_errors=6)
