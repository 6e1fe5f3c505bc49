from pyspark.sql import functions as F

from viewgraph.operators.heavy_keys import folded, heavy, key_profile
from viewgraph.scale import Workspace, attach, numbered_within


def test_written_tables_are_counted_and_can_go(spark):
    w = Workspace(spark, "t").write(spark.range(10).withColumn("x", F.lit("a")), F.sum("id"))
    assert (w.rows, w.mark, w.df.count()) == (10, 45, 10)
    empty = Workspace(spark, "t").write(spark.range(0))
    assert empty.rows == 0 and empty.df.collect() == []
    w.drop()
    space = Workspace(spark, "t")
    space.write(spark.range(3))
    space.drop()
    import os

    assert not os.path.exists(space.root.removeprefix("file://"))


def test_attach_joins_hot_and_cold_keys(spark):
    n = 60_000
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.lit(None).cast("long")).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, n, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert sorted(attach(left, right, "k", n, how).collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)


def test_numbered_within_counts_from_zero_without_gaps(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < 4000, 1).otherwise(2).alias("size"))
    out = numbered_within(df, "size", "name", 5000, most=300).collect()
    assert sorted(r["rank"] for r in out if r["size"] == 1) == list(range(4000))
    assert sorted(r["rank"] for r in out if r["size"] == 2) == list(range(1000))


def test_profiles_of_skewed_keys(spark):
    rows = [("a", "s", 1, 1, 1.0), ("a", "s", 1, 1, 1.0), ("a", "s", 2, 1, None), ("a", "t", 3, None, 3.0), ("a", "t", 4, 1, 2.0), ("b", None, 1, 5, None), (None, "s", 9, 9, 9.0)]
    df = spark.createDataFrame(rows, "k string, g string, id int, p int, x double")
    profile = lambda d, **more: key_profile(folded(d, ["k", "g"], ["id"], ["p", "x"], F.coalesce("p", -F.col("id"))), "k", ["g"], **more)
    whole = {"value": "p", "group": "g", "means": {"mean": "x"}, "names": ("points", "scenes")}
    got = {r.k: (r.rows, r.points, r.scenes, r["mean"], r.total) for r in profile(df, **whole).collect()}
    assert got == {"a": (4, 2, 2, 2.0, 6), "b": (1, 1, 0, None, 6)}
    assert [r.k for r in heavy(profile(df), 2).collect()] == ["a"]
    assert profile(df.limit(0), **whole).collect() == []


def test_a_name_that_holds_a_third_of_all_rows(spark):
    n = 30_000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(F.when(hot, F.lit("a")).otherwise(F.concat(F.lit("n"), F.col("id") % 100)).alias("k"), F.lit("s").alias("g"), (F.col("id") % 9000).alias("id"), (F.col("id") % 9000).alias("p"))
    rows = folded(df, ["k", "g"], ["id"], ["p"], F.floor(F.col("p") / 64))
    got = {r.k: (r.rows, r["values"]) for r in key_profile(rows, "k", ["g"], "p").collect()}
    want = df.distinct().groupBy("k").agg(F.count("p"), F.countDistinct("p")).collect()
    assert got == {r[0]: (r[1], r[2]) for r in want}
