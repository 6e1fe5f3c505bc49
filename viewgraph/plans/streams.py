"""Stream queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import incremental as st


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The files of one table: a folder of parts, or one file beside others.
    like = table(spark, sf_dir, "events")
    return st.read_stream(spark, sf_dir, like, "events.parquet")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day, kept complete while they come in."""
    days = _events(spark, sf_dir).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return st.run_to_end(spark, days, "complete")


def stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the sum of values per user."""
    users = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))
    return st.run_to_end(spark, users, "complete")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_users)}
SQL = {
    "stream_daily_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events GROUP BY ALL",
    "stream_users": "SELECT user_id, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
