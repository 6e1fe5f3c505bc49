import duckdb
import pytest
from pathlib import Path

from viewgraph.plans import registry

SMALL = Path("/root/testdata/sf0.001")
CHECKED = ["co_observation_edges", "match_graph", "rotations", "pose_summary", "depth_errors", "nearest_points", "stream_daily_counts", "p5_profile"]

#: Quaternions whose rotations have entries a last bit from half of 1e-6, at even and odd places.
TIES = [q for q in ((0.9314, 0.2313, -0.0425, 0.278), (0.914, 0.1954, 0.0581, -0.3508), (0.7, -0.592, 0.319, -0.2405), (0.8342, 0.2496, 0.4803, 0.1054)) for _ in range(2)]


def norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, str(SMALL)).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(repr(tuple(norm(v) for v in r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None)) for f in (got, want)]
    assert rows[0] == rows[1] and rows[0]


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_entry_has_all_queries_without_repeats():
    import __spark_entry__ as e

    names = [n for m in registry._MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(names) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_quarter_turns_round_as_sql_does(spark, tmp_path):
    rows = [("s", "0", i, list(q), [1.0, 2.0, 3.0]) for i, q in enumerate(TIES)]
    spark.createDataFrame(rows, "scene string, recon string, image_id long, qvec array<double>, tvec array<double>").write.parquet(str(tmp_path / "image.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW image AS SELECT * FROM '{tmp_path}/image.parquet/*.parquet'")
    got = registry.queries()["quarter_turn_poses"](spark, str(tmp_path)).toPandas()
    want = con.sql(registry.oracle_sql()["quarter_turn_poses"]).df()
    exact = [sorted(f[sorted(f.columns)].itertuples(index=False, name=None)) for f in (got, want)]
    assert len(exact[0]) == len(TIES) and exact[0] == exact[1]
