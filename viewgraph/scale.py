"""Building blocks that keep operators bounded and restartable at any size.

* ``Workspace`` writes intermediate tables to the folder in ``spark.checkpoint.dir``,
  which all executors share, so that lost executors cost no recomputation and iterative
  plans stay short.
* ``attach`` joins by a key of which few values may hold most rows.
* ``numbered_within`` ranks rows within a key without a task that holds a whole key.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows below which a side of two or three narrow columns is broadcast (some 32 MB).
BROADCAST_ROWS = 1_000_000
#: The same for a side that holds names.
BROADCAST_NAMES = 250_000
#: A key with more than this share of all rows counts as hot; there are at most 1000 such keys.
HOT_SHARE = 1e-3


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)  # for checkpoint()
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="viewgraph-")
    spark.sparkContext.setCheckpointDir(folder)
    atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Written:
    """A table in the shared folder, with what was observed while it was written."""

    df: DataFrame
    path: str
    rows: int
    mark: int

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


class Workspace:
    """Writes tables below the shared folder; each is counted in the same pass. Results read them after an operator
    has returned, so the tables stay until drop(), or until the driver's JVM ends, which deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def drop(self) -> None:
        _delete(self.spark, self.root)

    def write(self, df: DataFrame, mark: Column | None = None) -> Written:
        """mark: an aggregate with a long value, such as bit_xor of row hashes."""
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), (F.lit(0) if mark is None else mark).cast("long").alias("mark")).write.parquet(path)
        got = seen.get
        return Written(self.spark.read.schema(_nullable(df.schema)).parquet(path), path, int(got["rows"] or 0), int(got["mark"] or 0))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its known number of rows allows it, else unchanged."""
    return F.broadcast(df) if rows <= most else df


def attach(left: DataFrame, right: DataFrame, key: str, left_rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once, where few keys may hold most rows of left.

    Rows of hot keys (over HOT_SHARE of left, so at most 1/HOT_SHARE keys) meet a broadcast of
    those keys' rows of right; all others are joined by a shuffle in which no key is large.
    how is inner or left. left is read three times, so it should be a written table.
    Rows with a null key match nothing.
    """
    floor = max(10_000, int(left_rows * HOT_SHARE))
    if left_rows <= floor:
        return left.join(right, key, how)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor).select(key)
    is_hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    hot_right = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    marked = left.join(is_hot, key, "left")
    many = marked.where(F.col("__hot")).drop("__hot").join(hot_right, key, how)
    few = marked.where(F.col("__hot").isNull()).drop("__hot").join(right, key, how)
    return many.unionByName(few)


def numbered_within(df: DataFrame, key: str, order: str, rows: int, most: int = 500_000, to: str = "rank") -> DataFrame:
    """df with the number (from 0) of each row among those of its key, in an order that depends
    on order alone. Rows are ranked in buckets of some `most` rows, and buckets are offset by
    their sizes, so one key may hold all rows."""
    buckets = max(1, -(-rows // most))
    df = df.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = df.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)))
    return ranked.join(offsets, [key, "__b"]).withColumn(to, F.col("__o") + F.col("__r") - 1).drop("__b", "__r", "__o")
