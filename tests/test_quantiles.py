import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgraph.operators.quantiles import quantile


@pytest.mark.parametrize(("share", "held"), [(0.5, 1), (0.5, 10), (0.9, 3), (0.0, 2), (1.0, 2), (0.333, 10**6)])
def test_quantiles_are_those_of_percentile(spark, share, held):
    rng = np.random.default_rng(int(share * 100) + held)
    rows = [("normal", float(x)) for x in rng.normal(size=1501)] + [("ties", float(x)) for x in rng.integers(0, 4, 1000)] + [("wide", float(x)) for x in 10.0 ** rng.uniform(-9, 9, 400)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), ("none", None), ("none", float("nan")), (None, 4.0), ("hot", 1.0), *[("hot", 2.0)] * 800]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {r[0]: r[1] for r in df.where("x is not null and not isnan(x)").groupBy("k").agg(F.percentile("x", F.lit(share))).collect()}
    got = {r.k: r.value for r in quantile(df.where("k is not null"), ["k"], "x", share, held).collect()}
    want.pop(None)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert [r.value for r in quantile(df.where("k = 'normal'"), [], "x", share, held).collect()] == [pytest.approx(want["normal"], rel=1e-12)]
    assert quantile(df.limit(0), ["k"], "x", share, held).collect() == []
