"""Image files without an image library: PNG pixels, and sizes and EXIF of JPEG and PNG files.

Pixels of other formats need a codec that is not at hand; their rows have an error and stop nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters

_PNG = b"\x89PNG\r\n\x1a\n"
# Channels by PNG colour type; palettes are not read.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
# Tags of EXIF, and bytes of its types.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x8769: "exif", 0x920A: "focal", 0xA405: "focal35", 0xA434: "lens"}
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii")}
META = "width int, height int, has_exif boolean, orientation int, make string, model string, lens string, focal int, focal35 int"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(_PNG):
        raise ValueError("no PNG file")
    at = len(_PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; step is the bytes of a pixel."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    for i, line in enumerate(lines):
        kind, row = line[0], line[1:]
        if kind == 1:
            above = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            above = row + above
        elif kind in (3, 4):
            left, corner, now = np.zeros(step, np.int64), np.zeros(step, np.int64), row.reshape(-1, step).astype(np.int64)
            up = above.reshape(-1, step).astype(np.int64)
            for x in range(len(now)):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    to = left + up[x] - corner
                    a, b, c = abs(to - left), abs(to - up[x]), abs(to - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left, corner = (now[x] + guess) & 255, up[x]
                now[x] = left
            above = now.astype(np.uint8).ravel()
        else:
            above = row
        out[i] = above
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of 8 or 16 bits a channel, without palette or interlacing: (h, w) or (h, w, channels)."""
    pixels, head = [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            pixels.append(body)
    if head is None:
        raise ValueError("no header")
    w, h, bits, color, _, _, interlaced = head
    if bits not in (8, 16) or color not in _CHANNELS or interlaced:
        raise ValueError(f"bits {bits}, colour type {color}, interlacing {interlaced}")
    step = _CHANNELS[color] * bits // 8
    rows = _unfiltered(np.frombuffer(zlib.decompress(b"".join(pixels)), np.uint8).reshape(h, w * step + 1), step)
    out = rows.view(">u2").astype(np.uint16) if bits == 16 else rows
    return out.reshape(h, w) if color == 0 else out.reshape(h, w, _CHANNELS[color])


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of uint8 or uint16 pixels, (h, w) or (h, w, channels); lines are stored as differences from the one above."""
    h, w = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    color = {n: c for c, n in _CHANNELS.items()}[channels]
    bits = 16 if pixels.dtype == np.uint16 else 8
    rows = pixels.astype(">u2" if bits == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    lines = np.full((h, rows.shape[1] + 1), 2, np.uint8)
    lines[:, 1:] = rows
    lines[1:, 1:] -= rows[:-1]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _directory(data: bytes, at: int, order: str, out: dict) -> None:
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if tag not in _TAGS or kind not in _TYPES:
            continue
        size, form = _TYPES[kind]
        where = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if kind == 2:
            out[_TAGS[tag]] = data[where : where + count].split(b"\0")[0].decode("utf-8", "ignore")
        else:
            value = struct.unpack_from(order + form, data, where)
            out[_TAGS[tag]] = value[0] if len(value) == 1 else value


def read_exif(data: bytes) -> dict | None:
    """make, model, orientation, lens, focal and focal35 as far as a TIFF block holds them; None if it can't be read."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        out: dict = {}
        _directory(data, struct.unpack_from(order + "I", data, 4)[0], order, out)
        if "exif" in out:
            _directory(data, out.pop("exif"), order, out)
        return out
    except (KeyError, struct.error):
        return None


def exif_bytes(meta: dict) -> bytes:
    """A TIFF block with the entries of meta that aren't None: texts for make, model and lens, 16 bits for the rest."""
    number = {n: t for t, n in _TAGS.items()}
    inner = {k: meta[k] for k in ("focal", "focal35", "lens") if meta.get(k) is not None}
    outer = {k: meta[k] for k in ("make", "model", "orientation") if meta.get(k) is not None}
    data = bytearray(b"II*\0\x08\0\0\0")

    def directory(entries: dict, at: int, link: int | None) -> bytes:
        rows = [(number[k], v) for k, v in entries.items()] + ([(number["exif"], link)] if link else [])
        tail_at, tail, out = at + 6 + 12 * len(rows), b"", struct.pack("<H", len(rows))
        for tag, v in sorted(rows, key=lambda r: r[0]):
            if isinstance(v, str):
                text = v.encode("utf-8") + b"\0"
                out += struct.pack("<HHI", tag, 2, len(text)) + (text.ljust(4, b"\0") if len(text) <= 4 else struct.pack("<I", tail_at + len(tail)))
                tail += text if len(text) > 4 else b""
            else:
                out += struct.pack("<HHII", tag, 4, 1, v) if tag == number["exif"] else struct.pack("<HHIHH", tag, 3, 1, v, 0)
        return out + struct.pack("<I", 0) + tail

    first = directory(outer, 8, 1 if inner else None)
    if inner:
        first = directory(outer, 8, 8 + len(first))
        data += first + directory(inner, 8 + len(first), None)
    else:
        data += first
    return bytes(data)


def read_meta(data: bytes) -> dict:
    """Size and EXIF of a JPEG or PNG file."""
    exif, size = None, None
    if data.startswith(_PNG):
        for kind, body in _chunks(data):
            if kind == b"IHDR":
                size = struct.unpack_from(">II", body)
            elif kind == b"eXIf":
                exif = read_exif(body)
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, length = struct.unpack_from(">BH", data, at + 1)
            body = data[at + 4 : at + 2 + length]
            if kind == 0xE1 and body[:6] == b"Exif\0\0":
                exif = read_exif(body[6:])
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame
                h, w = struct.unpack_from(">HH", body, 1)
                size = (w, h)
                break
            at += 2 + length
    if size is None:
        raise ValueError("no image size found")
    whole = lambda v: v if isinstance(v, int) else None  # noqa: E731  # focal lengths count if they are whole numbers
    e = exif or {}
    texts = {k: e[k].lower() if isinstance(e.get(k), str) else "" for k in ("make", "model", "lens")}
    return {"width": size[0], "height": size[1], "has_exif": exif is not None, "orientation": whole(e.get("orientation")), "focal": whole(e.get("focal")), "focal35": whole(e.get("focal35"))} | texts


def jpeg_head(width: int, height: int, meta: dict | None) -> bytes:
    """A JPEG file that ends after its frame header, with EXIF if meta is given: all that metadata readers look at."""
    out = b"\xff\xd8"
    if meta is not None:
        block = b"Exif\0\0" + exif_bytes(meta)
        out += b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00" + b"\xff\xd9"


def read_metadata(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, readable, the columns of META, error: all image files below a folder. Only a file's head is looked at; an empty file has no row."""
    names = [x.split()[0] for x in META.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    meta = read_meta(bytes(content))
                    out.append((p, True, *[meta[n] for n in names], None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, False, *[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
            frame = pd.DataFrame(out, columns=["path", "readable", *names, "error"])
            yield frame.astype({n: "Int32" for n in ("width", "height", "orientation", "focal", "focal35")})

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", "content").mapInPandas(rows, f"path string, readable boolean, {META}, error string")


def kept_images(meta: DataFrame) -> DataFrame:
    """The rows of read_metadata whose image passes the filter of fisheyes and panoramas."""
    round_ = filters.fisheye(F.col("lens"), F.col("focal"), F.col("focal35"))
    return meta.where(filters.keep_image(F.col("readable"), F.col("has_exif"), round_, filters.panorama(F.col("path"), F.col("width"), F.col("height"))))
