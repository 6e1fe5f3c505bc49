"""Streams: counts that keep up with newly written observations, matches and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import Workspace


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each row once, as long as its repetition comes within the watermark; state is dropped beyond it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], time: str, length: str, late: str = "1 day") -> DataFrame:
    """keys, start, rows: tumbling windows over the event time, final once the watermark has passed them."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(*keys, F.col("window.start").alias("start"), "rows")


def session_counts(stream: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 day") -> DataFrame:
    """keys, start, end, rows: sessions that end after a gap."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


def run_to_end(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its result. Output and progress are in the shared
    folder, so a restarted run goes on where the last one ended. In append mode results come as batches of
    parquet; complete results are one table replaced by each batch."""
    space = Workspace(spark, "stream")
    path, progress = f"{space.root}/out", f"{space.root}/progress"
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def read_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)
