"""Whole files on any file system that executors reach: local paths, and URIs that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import io
import mmap
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all; a task that runs twice leaves one."""
    system, at = located(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


@contextmanager
def opened(path: str, binary: bool) -> Iterator:
    """A file's content: bytes or a mapped local file if binary, else its lines."""
    system, at = located(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(at, "rb") as f:
            if not binary:
                yield f
            elif os.fstat(f.fileno()).st_size:
                with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                    yield mapped
            else:
                yield b""
        return
    with system.open_input_stream(at) as f:
        yield f.read() if binary else io.BufferedReader(f)


def exists(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type == fs.FileType.File


def write_files(df: DataFrame, path: str, content: str) -> DataFrame:
    """Writes content (binary or text) to path for each row, lazily, and returns (path, bytes, error). A null content or path,
    and a file that can't be written, are rows with an error and stop nothing."""
    binary = dict(df.dtypes)[content] == "binary"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    data = bytes(c) if binary else c.encode("utf-8")
                    put(p, data)
                    out.append((p, len(data), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"]).astype({"bytes": "Int64"})

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(each, "path string, bytes long, error string")
