"""Match databases in SQLite: a data source with column pruning and filters inside the database, and a writer."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from glob import glob
from itertools import islice
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, InputPartition, IsNotNull

from ..operators.graph import flat_name, pair_images
from ..schema import PAIR_BASE

# The tables with their columns.
DDL = {
    "cameras": "camera_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, model INTEGER NOT NULL, width INTEGER NOT NULL, height INTEGER NOT NULL, params BLOB, prior_focal_length INTEGER NOT NULL",
    "images": "image_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, name TEXT NOT NULL UNIQUE, camera_id INTEGER NOT NULL, prior_qw REAL, prior_qx REAL, prior_qy REAL, prior_qz REAL, prior_tx REAL, prior_ty REAL, prior_tz REAL, "
    f"CONSTRAINT image_id_check CHECK(image_id >= 0 and image_id < {PAIR_BASE}), FOREIGN KEY(camera_id) REFERENCES cameras(camera_id)",
    "keypoints": "image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB, FOREIGN KEY(image_id) REFERENCES images(image_id) ON DELETE CASCADE",
    "descriptors": "image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB, FOREIGN KEY(image_id) REFERENCES images(image_id) ON DELETE CASCADE",
    "matches": "pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB",
    "two_view_geometries": "pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB, config INTEGER NOT NULL, F BLOB, E BLOB, H BLOB",
}
SCHEMAS = {
    "cameras": "camera_id long, model long, width long, height long, params binary, prior_focal_length long",
    "images": "image_id long, name string, camera_id long, prior_qw double, prior_qx double, prior_qy double, prior_qz double, prior_tx double, prior_ty double, prior_tz double",
    "keypoints": "image_id long, rows long, cols long, data binary",
    "descriptors": "image_id long, rows long, cols long, data binary",
    "matches": "pair_id long, rows long, cols long, data binary",
    "two_view_geometries": "pair_id long, rows long, cols long, data binary, config long, F binary, E binary, H binary",
}
#: Small files of a pattern are read together, in at least so many partitions if there are as many, of up to so many bytes; larger files are parted.
PACKS, PACK_BYTES, LARGE_BYTES = 64, 64 << 20, 8 << 20


class Source(DataSource):
    """Options: path (a file, or a pattern of files that executors reach by it), table, columns (names with commas; default all), parts
    (ranges of rowid of a file, read in parallel). Rows of a pattern have their file's path as one more column."""

    @classmethod
    def name(cls) -> str:
        return "match_database"

    def schema(self) -> str:
        wanted = self._columns()
        return ", ".join([x for x in SCHEMAS[self.options["table"]].split(", ") if x.split()[0] in wanted] + ["path string"] * ("*" in self.options["path"]))

    def _columns(self) -> list[str]:
        every = [x.split()[0] for x in SCHEMAS[self.options["table"]].split(", ")]
        asked = self.options.get("columns")
        return [c for c in every if c in [x.strip() for x in asked.split(",")]] if asked else every

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options["table"], self._columns(), int(self.options.get("parts", "1")))


class Pieces(InputPartition):
    """(path, k, n): the k-th of n ranges of rowid of a file."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list) -> Iterable:
        """NOT NULL and > run inside the database, so no blob of a dropped row is read."""
        for f in filters:
            if isinstance(f, (IsNotNull, GreaterThan)) and f.attribute == ("path",):
                yield f
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append(f'"{f.attribute[0]}" IS NOT NULL')
            elif isinstance(f, GreaterThan) and len(f.attribute) == 1 and isinstance(f.value, (int, float)):
                self.where.append(f'"{f.attribute[0]}" > ?')
                self.values.append(f.value)
            else:
                yield f

    def _open(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)

    def partitions(self) -> list[Pieces]:
        """The driver opens no file. Of a pattern, small files share a partition, and only large ones are parted."""
        if "*" not in self.path:
            return [Pieces([(self.path, k, self.parts)]) for k in range(self.parts)]
        sizes = {path: os.path.getsize(path) for path in sorted(glob(self.path))}
        most = min(PACK_BYTES, sum(sizes.values()) // PACKS + 1)
        out, room = [], 0
        for path, size in sizes.items():
            if size > max(most, LARGE_BYTES):
                out += [Pieces([(path, k, self.parts)]) for k in range(self.parts)]
                room = 0
            elif size <= room:
                out[-1].pieces.append((path, 0, 1))
                room -= size
            else:
                out.append(Pieces([(path, 0, 1)]))
                room = most - size
        return out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        for path, k, n in partition.pieces:
            con = self._open(path)
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if low is not None:
                step = -(-(high - low + 1) // n)
                more = (path,) if "*" in self.path else ()
                for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', [low + k * step, min(high, low + (k + 1) * step - 1), *self.values]):
                    yield (*row, *more)
            con.close()


def read(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, parts: int = 1) -> DataFrame:
    spark.dataSource.register(Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("match_database").option("path", path).option("table", table).option("parts", str(parts))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def read_pairs(spark: SparkSession, path: str, table: str = "two_view_geometries", least: int = 16, parts: int = 1) -> DataFrame:
    """src, dst (names with blanks as underscores), matches_num of verified pairs with more than `least` matches.
    The count is stored, so no list of matches is decoded. path may be a pattern of databases; rows then have their path."""
    keys = ["path"] if "*" in path else []
    pairs = read(spark, path, table, ["pair_id", "rows", "data"], parts).where(F.col("data").isNotNull() & (F.col("rows") > least))
    a, b = pair_images(F.col("pair_id"))
    names = read(spark, path, "images", ["image_id", "name"]).select(*keys, "image_id", flat_name(F.col("name")).alias("name"))
    out = pairs.select(*keys, a.alias("a"), b.alias("b"), F.col("rows").alias("matches_num"))
    return out.join(names.toDF(*keys, "a", "src"), [*keys, "a"]).join(names.toDF(*keys, "b", "dst"), [*keys, "b"]).select(*keys, "src", "dst", "matches_num")


def blob_array(dtype: str, element: str):
    """A Pandas UDF: binary column to an array of numbers."""

    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, dtype).tolist())

    return F.pandas_udf(decode, f"array<{element}>")


def array_blob(dtype: str):
    """A Pandas UDF: array of numbers to a binary column."""

    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, dtype).tobytes())

    return F.pandas_udf(encode, "binary")


def match_pairs(data: Column) -> Column:
    """A list of matches (uint32, two columns) as an array of (i, j)."""

    def decode(blobs: pd.Series) -> pd.Series:
        pairs = (None if b is None else np.frombuffer(b, "<u4").reshape(-1, 2).tolist() for b in blobs)
        return pd.Series([None if p is None else [{"i": i, "j": j} for i, j in p] for p in pairs], dtype=object)

    return F.pandas_udf(decode, "array<struct<i: long, j: long>>")(data)


def create(path: str, flushed: bool = True) -> sqlite3.Connection:
    """A database with its tables, made in one transaction. flushed=False leaves it to the system when bytes reach the disk, as
    other sinks do; a task that dies still leaves a database whole."""
    con = sqlite3.connect(path)
    if not flushed:
        con.execute("PRAGMA synchronous = OFF")
    with con:
        con.execute("BEGIN")
        for table, columns in DDL.items():
            con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns})")
        con.execute("CREATE UNIQUE INDEX IF NOT EXISTS index_name ON images(name)")
    return con


def write_databases(df: DataFrame, path: str, table: str) -> DataFrame:
    """Appends rows to a table of the database that each row names by its path, one task for each database, lazily: path, rows,
    error. A task that runs twice writes once: rows with a key that is there are passed over."""
    names = [x.split()[0] for x in SCHEMAS[table].split(", ") if x.split()[0] in df.columns]
    sql = f"INSERT OR IGNORE INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})"

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            os.makedirs(os.path.dirname(key[0]), exist_ok=True)
            con = create(key[0], flushed=False)
            with con:
                con.executemany(sql, pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None))
            con.close()
            return pd.DataFrame({"path": [key[0]], "rows": [len(pdf)], "error": [None]})
        except (OSError, sqlite3.Error) as e:
            return pd.DataFrame({"path": [key[0]], "rows": [0], "error": [f"{type(e).__name__}: {e}"[:200]]})

    return df.select(F.col(path).alias("path"), *names).groupBy("path").applyInPandas(each, "path string, rows long, error string")


def write(df: DataFrame, path: str, table: str) -> int:
    """Appends rows to a table of one database on the driver. For many databases see write_databases."""
    names = [x.split()[0] for x in SCHEMAS[table].split(", ") if x.split()[0] in df.columns]
    con = create(path)
    sql = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})"
    n = 0
    with con:
        rows = ([bytes(v) if isinstance(v, bytearray) else v for v in row] for row in df.select(*names).toLocalIterator())
        while batch := list(islice(rows, 10_000)):
            con.executemany(sql, batch)
            n += len(batch)
    con.close()
    return n


def canonical_matches(df: DataFrame, a: str, b: str, matches: str) -> DataFrame:
    """pair_id, matches (array of (i, j)): pairs with the lesser image first, their columns swapped where they were not."""
    from ..operators.graph import pair_id

    swapped = F.transform(matches, lambda m: F.struct(m["j"].alias("i"), m["i"].alias("j")))
    return df.select(pair_id(F.col(a), F.col(b)).alias("pair_id"), F.when(F.col(a) > F.col(b), swapped).otherwise(F.col(matches)).alias("matches"))
