"""Frames as image files: ``write.format("frames")`` and ``read_frames``.

Sparse pixels are put together to dense frames in Spark (``dense``), one group a frame; the sink encodes each frame as PNG and writes it to
a file of its own name. A file that exists stays as it is, so a broken-off or repeated run writes only what
is missing; of two rows with one name one is written. What a failed task or a lost executor left staged is never moved to its place.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from . import storage

FRAME = "name string, height int, width int, channels int, pixels binary"
#: Fixed value of the format.
PNG = b"\x89PNG\r\n\x1a\n"


# ------------------------------------------------------------ PNG
def encode(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width) gray or (height, width, 3) colours, 8 bits each."""
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, -1)
    raw = np.zeros((height, rows.shape[1] + 1), np.uint8)  # each row says it isn't filtered
    raw[:, 1:] = rows
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw.tobytes(), 1)) + part(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray | None:
    """The pixels of a PNG of 8-bit gray or colours, not interlaced; None of anything else."""
    if raw[:8] != PNG:
        return None
    at, head, body = 8, None, []
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        return None
    width, height, step = head[0], head[1], 3 if head[3] else 1
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, -1)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for k, (how, row) in enumerate(zip(rows[:, 0], rows[:, 1:])):
        if how == 0:
            above = row
        elif how == 1:
            above = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif how == 2:
            above = above + row
        else:
            above = _filtered(row, above, step, how)
        out[k] = above
    return out.reshape((height, width, 3) if step == 3 else (height, width))


def _filtered(row: np.ndarray, above: np.ndarray, step: int, how: int) -> np.ndarray:
    """A row whose pixels follow from those to the left and above: their mean (3) or the nearest of three (4)."""
    out = [0] * step
    up = [0] * step + above.tolist()
    for k, v in enumerate(row.tolist()):
        a, b, c = out[k], up[k + step], up[k]
        if how == 3:
            guess = (a + b) // 2
        else:
            guess = min((a, b, c), key=lambda x: abs(a + b - c - x))
        out.append((v + guess) & 255)
    return np.array(out[step:], np.uint8)


# ------------------------------------------------------------ frames
def to_bytes(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to 255 as they are; others as shares of the largest, which becomes 255."""
    if values.dtype.kind in "iu" and values.size and values.min() >= 0 and values.max() <= 255:
        return values.astype(np.uint8)
    most = values.max() if values.size else 0
    return (np.clip(values / most if most > 0 else values, 0, 1) * 255).astype(np.uint8)


def dense(pixels: DataFrame, keys: list[str], name: Column, height: int, width: int, value: str = "v", fill: float = 0, channel: str | None = None) -> DataFrame:
    """Rows of ``FRAME`` with ``keys``: the frames of sparse pixels (keys, y, x, value), ``fill`` where there is none. ``channel``: a column 0, 1, 2
    for colours. Of two values of a pixel the larger counts; pixels off the frame are left out, and a frame of none but those is all ``fill``."""
    whole = dict(pixels.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    rows = pixels.select(*keys, name.alias("name"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col(channel).cast("int") if channel else F.lit(0)).alias("c"), F.col(value).cast("long" if whole else "double").alias("v"))
    depth = 3 if channel else 1

    def run(table: pa.Table) -> pa.Table:
        y, x, c = (table.column(n).to_numpy() for n in "yxc")
        v = table.column("v").to_numpy()
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width) & (c >= 0) & (c < depth)
        lowest = np.iinfo(np.int64).min if whole else -np.inf
        frame = np.full((height, width, depth), lowest, np.int64 if whole else np.float64)
        np.maximum.at(frame, (y[inside], x[inside], c[inside]), v[inside])
        frame[frame == lowest] = fill
        one = table.slice(0, 1)
        return pa.table([*(one.column(k) for k in [*keys, "name"]), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([depth], pa.int32()), pa.array([to_bytes(frame).tobytes()], pa.binary())], names=[*keys, "name", "height", "width", "channels", "pixels"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FRAME)


@dataclass
class FrameWriter(storage.StagedWriter):
    suffix: str = ".png"

    def write(self, iterator):
        attempt, names, seen, skipped = self.attempt(), [], set(), 0
        for batch in iterator:
            for row in batch.to_pylist():
                name = row["name"]
                shape = (row["height"], row["width"]) + ((3,) if row["channels"] == 3 else ())
                pixels = row["pixels"]
                if name in seen or self.keep and self.exists(name) or row["channels"] not in (1, 3) or pixels is None or len(pixels) != int(np.prod(shape)):
                    skipped += 1
                    continue
                with self.open(f"{attempt}/{name}") as out:
                    out.write(encode(np.frombuffer(pixels, np.uint8).reshape(shape)))
                names.append(f"{attempt}/{name}")
                seen.add(name)
        return storage.Written(names, len(names), skipped)


class Frames(ds.DataSource):
    """The sink of rows of ``FRAME``. Mode ``append`` keeps files that exist; ``overwrite`` replaces the folder's images. Frames of other
    shapes than height x width x 1 or 3 are passed over."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return FRAME

    def writer(self, schema, overwrite):
        return FrameWriter(self.options["path"], overwrite, keep=not overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, pixels) of the PNG files of a folder; nulls for other kinds of PNG."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x) for x in batch.column("content").to_pylist()]
            size = lambda k: [None if p is None else p.shape[k] for p in found]  # noqa: B023, E731
            depth = [None if p is None else 3 if p.ndim == 3 else 1 for p in found]
            pixels = [None if p is None else p.tobytes() for p in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(size(0), pa.int32()), pa.array(size(1), pa.int32()), pa.array(depth, pa.int32()), pa.array(pixels, pa.binary())], ["path", "height", "width", "channels", "pixels"])

    return files.mapInArrow(run, "path string, height int, width int, channels int, pixels binary")
