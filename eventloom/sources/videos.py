"""Frames of uncompressed video: ``spark.read.format("y4m")`` and ``df.write.format("y4m")``.

A YUV4MPEG2 file is a line that names the size and the rate, and then frames of equal length, each behind a line of its own. So a frame's place
follows from its number: partitions are stretches of frames, and of every n-th frame (option ``every``) only those bytes are
read. Columns: ``file``, ``frame`` (its number), ``t`` (seconds, by the rate), ``height``, ``width`` and ``pixels``, the gray or luma plane;
what a file holds of colour is passed over. Option ``crop``: rows to leave out at the bottom of each frame. Filters on ``frame`` pushed down leave out frames outside.

Lines of frames are to be without parameters, as encoders write them. The sink writes gray files: rows (frame, height, width, pixels) in
the order of their partition, a file for each partition; option ``rate`` (frames a second, 25).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from . import storage

# Fixed values of the format: first word, a frame's line, bytes of colour planes per pixel by name.
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"
CHROMA = {"mono": 0.0, "420": 0.5, "420jpeg": 0.5, "420paldv": 0.5, "420mpeg2": 0.5, "422": 1.0, "444": 2.0}
SUFFIXES = (".y4m",)
COLUMNS = "file string, frame long, t double, height int, width int, pixels binary"


@dataclass
class Video:
    origin: int
    width: int
    height: int
    rate: float
    stride: int
    frames: int


def header(f, size: int) -> Video:
    f.seek(0)
    line = f.read(1024).split(b"\n")[0]
    words = line.split(b" ")
    if words[0] != MAGIC:
        raise ValueError("not a YUV4MPEG2 file")
    params = {w[:1].decode(): w[1:].decode() for w in words[1:]}
    width, height, kind = int(params["W"]), int(params["H"]), params.get("C", "420")
    up, _, down = params.get("F", "25:1").partition(":")
    if kind not in CHROMA:
        raise ValueError(f"planes of kind {kind} can't be read")
    colour = 2 * ((width + 1) // 2) * ((height + 1) // 2) if CHROMA[kind] == 0.5 else 2 * ((width + 1) // 2) * height if CHROMA[kind] == 1.0 else int(CHROMA[kind]) * width * height
    stride = len(FRAME) + width * height + colour
    return Video(len(line) + 1, width, height, int(up) / int(down or 1), stride, (size - len(line) - 1) // stride)


@dataclass
class Stretch(ds.InputPartition):
    path: str
    first: int
    stop: int
    video: Video | None

    def __post_init__(self):
        super().__init__((self.path, self.first, self.stop))


class Y4mReader(ds.DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names, self.address = schema.names, options["path"]
        self.every, self.rows = int(options.get("every", 1)), int(options.get("rows", 256))
        self.crop = int(options.get("crop", 0))
        self.lo, self.hi = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        """Bounds of ``frame``; Spark still applies all filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                if type(f) in (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo):
                    self.lo = max(self.lo, int(f.value))
                if type(f) in (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo):
                    self.hi = min(self.hi, int(f.value))
            yield f

    def _stretches(self, found: tuple[str, int]) -> list[Stretch]:
        path, size = found
        system, _ = storage.at(self.address)
        with system.open_input_file(path) as f:
            v = header(f, size)
        step = self.rows * self.every
        first = -(-self.lo // self.every) * self.every
        return [Stretch(path, k, min(v.frames, self.hi + 1, k + step), v) for k in range(first, min(v.frames, self.hi + 1), step)]

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            out = [s for some in pool.map(self._stretches, storage.listing(self.address, SUFFIXES)) for s in some]
        return out or [Stretch("", 0, 0, None)]

    def read(self, partition: Stretch):
        v = partition.video
        if v is None:
            return
        system, _ = storage.at(self.address)
        height = max(0, v.height - self.crop)
        together = max(1, (4 << 20) // max(1, v.width * height))
        with system.open_input_file(partition.path) as f:
            numbers = list(range(partition.first, partition.stop, self.every))
            for k in range(0, len(numbers), together):
                some, pixels = numbers[k : k + together], []
                for n in some if "pixels" in self.names else ():
                    f.seek(v.origin + n * v.stride)
                    raw = f.read(len(FRAME) + v.width * height)
                    if not raw.startswith(FRAME):
                        raise ValueError(f"frame {n} of {partition.path} doesn't stand where it should")
                    pixels.append(raw[len(FRAME) :])
                columns = {
                    "file": lambda: pa.array([partition.path.rpartition("/")[2]] * len(some)),  # noqa: B023
                    "frame": lambda: pa.array(some, pa.int64()),  # noqa: B023
                    "t": lambda: pa.array([n / v.rate for n in some], pa.float64()),  # noqa: B023
                    "height": lambda: pa.array([height] * len(some), pa.int32()),  # noqa: B023
                    "width": lambda: pa.array([v.width] * len(some), pa.int32()),  # noqa: B023
                    "pixels": lambda: pa.array(pixels, pa.binary()),  # noqa: B023
                }
                yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], list(self.names))


@dataclass
class Y4mWriter(storage.StagedWriter):
    rate: int = 25
    suffix: str = ".y4m"

    def write(self, iterator):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), self.attempt()
        name, out, size, rows = f"{attempt}/part-{part:05d}-{attempt[:8]}.y4m", None, None, 0
        for batch in iterator:
            for r in batch.select(["height", "width", "pixels"]).to_pylist():
                if out is None:
                    size = (r["height"], r["width"])
                    out = self.open(name)
                    out.write(MAGIC + f" W{size[1]} H{size[0]} F{self.rate}:1 Ip Cmono\n".encode())
                if (r["height"], r["width"]) != size or len(r["pixels"]) != size[0] * size[1]:
                    raise ValueError("frames of one video are to be of one size")
                out.write(FRAME + r["pixels"])
                rows += 1
        if out is not None:
            out.close()
        return storage.Written([name] if rows else [], rows)


class Y4m(ds.DataSource):
    @classmethod
    def name(cls):
        return "y4m"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return Y4mReader(schema, self.options)

    def writer(self, schema, overwrite):
        return Y4mWriter(self.options["path"], overwrite, rate=int(self.options.get("rate", 25)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Y4m)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
