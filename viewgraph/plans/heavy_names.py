"""Names that hold most observations and sample entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heavy_keys import BUCKET, folded, heavy, key_profile
from ..session import table


def observation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, rows, scenes, points, mean_x, mean_y, total over distinct observations. A point3d_id of -1 is no point."""
    point = F.when(F.col("point3d_id") >= 0, F.col("point3d_id"))
    rows = table(spark, sf_dir, "observation").select("name", "scene", "recon", "image_id", "idx", "x", "y", point.alias("point"))
    # Images of one name in a reconstruction are one part. Equal points share a bucket; rows without one are spread by their place.
    bucket = F.floor(F.coalesce(F.col("point"), -1 - F.col("idx")) / BUCKET)
    rows = folded(rows, ["name", "scene", "recon"], ["image_id", "idx"], ["x", "y", "point"], bucket)
    return key_profile(rows, "name", ["scene", "recon"], "point", "scene", {"mean_x": "x", "mean_y": "y"}, ("points", "scenes"))


def entry_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, rows, scenes, total over distinct (sample_uid, key of imgs) entries."""
    rows = table(spark, sf_dir, "sampled_case").select("sample_uid", "scene", F.explode(F.map_keys("imgs")).alias("name"))
    rows = folded(rows, ["name", "scene"], ["sample_uid"], [], F.floor(F.col("sample_uid") / BUCKET))
    return key_profile(rows, "name", ["scene"], group="scene", names=("", "scenes"))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results per name of observation, for all names."""
    profile = observation_profile(spark, sf_dir)
    return profile.select("name", "rows", "scenes", "points", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"))


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results per name of the entries of sampled_case.imgs, for all names."""
    return entry_profile(spark, sf_dir).select("name", "rows", "scenes")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with more than 1/50 of all distinct observations or entries: those of the whole profiles that are heavy."""
    seen = heavy(observation_profile(spark, sf_dir)).select(F.lit("observation").alias("table_name"), "name")
    sampled = heavy(entry_profile(spark, sf_dir)).select(F.lit("sampled_case").alias("table_name"), "name")
    return seen.unionAll(sampled)


QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile, "p5_entries": p5_entries}

_ROWS = "(SELECT DISTINCT scene, recon, image_id, idx, name, x, y, point3d_id FROM observation)"
_ENTRIES = "(SELECT DISTINCT sample_uid, scene, unnest(map_keys(imgs)) AS name FROM sampled_case)"
SQL = {
    "p5_found": f"""
        SELECT 'observation' AS table_name, name FROM {_ROWS} GROUP BY name
        HAVING count(*) * 50 > (SELECT count(*) FROM {_ROWS})
        UNION ALL
        SELECT 'sampled_case', name FROM {_ENTRIES} GROUP BY name HAVING count(*) * 50 > (SELECT count(*) FROM {_ENTRIES})""",
    "p5_profile": f"""
        SELECT name, count(*) AS rows, count(DISTINCT scene) AS scenes,
               count(DISTINCT CASE WHEN point3d_id >= 0 THEN (scene, recon, point3d_id) END) AS points,
               round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y
        FROM {_ROWS} GROUP BY name""",
    "p5_entries": f"SELECT name, count(*) AS rows, count(DISTINCT scene) AS scenes FROM {_ENTRIES} GROUP BY name",
}
