"""Events of bag files: ``spark.read.format("bag_events")`` and ``df.write.format("bag_events")``.

A bag (ROS bag, version 2.0) ends with an index: its connections, and for each chunk of messages its place and the times it spans. The
driver reads that index alone; chunks are the partitions, and filters on ``t_ns`` pushed down leave out chunks that
lie outside. Columns: ``file``, ``topic``, ``t_ns``, ``x``, ``y``, ``p`` of the event arrays on each topic; option ``topic`` picks one.

Chunks may be plain or bz2. A bag that was cut off before its index was written can't be read. The sink writes (t_ns, x, y, p), sorted by time
within partitions, as bags of at most about 64 MB; options ``topic``, ``chunk`` (events in a message; a chunk holds 16) and ``compression`` (none, bz2).
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from . import storage

# Fixed values of the format: first line, kinds of records, the type of event arrays and one event's layout.
VERSION = b"#ROSBAG V2.0\n"
MESSAGE, BAG_HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
EVENT_ARRAY = "dvs_msgs/EventArray"
EVENT = np.dtype([("x", "<u2"), ("y", "<u2"), ("secs", "<u4"), ("nsecs", "<u4"), ("p", "u1")])

SUFFIXES = (".bag",)
COLUMNS = "file string, topic string, t_ns long, x int, y int, p int"


def fields(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at + 4 <= len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        name, _, value = raw[at + 4 : at + 4 + size].partition(b"=")
        out[name.decode()] = value
        at += 4 + size
    return out


def records(raw: bytes, at: int = 0) -> Iterator[tuple[dict[str, bytes], bytes, int]]:
    """(header, data, place) of the records from a place on."""
    while at + 8 <= len(raw):
        n = struct.unpack_from("<I", raw, at)[0]
        m = struct.unpack_from("<I", raw, at + 4 + n)[0]
        yield fields(raw[at + 4 : at + 4 + n]), raw[at + 8 + n : at + 8 + n + m], at
        at += 8 + n + m


def _time(raw: bytes) -> int:
    secs, nsecs = struct.unpack("<II", raw)
    return secs * 10**9 + nsecs


def index(f, size: int) -> tuple[dict[int, tuple[str, str]], list[tuple[int, int, int]]]:
    """({connection: (topic, type)}, [(place, first ns, last ns) of each chunk]) from a bag's end."""
    f.seek(0)
    head = f.read(4096)
    if not head.startswith(VERSION):
        raise ValueError("not a bag of version 2.0")
    n = struct.unpack_from("<I", head, len(VERSION))[0]
    at = struct.unpack("<Q", fields(head[len(VERSION) + 4 : len(VERSION) + 4 + n])["index_pos"])[0]
    if not at:
        raise ValueError("the bag has no index")
    f.seek(at)
    topics, chunks = {}, []
    for h, data, _ in records(f.read(size - at)):
        if h["op"][0] == CONNECTION:
            topics[struct.unpack("<I", h["conn"])[0]] = (h["topic"].decode(), fields(data).get("type", b"").decode())
        elif h["op"][0] == CHUNK_INFO:
            chunks.append((struct.unpack("<Q", h["chunk_pos"])[0], _time(h["start_time"]), _time(h["end_time"])))
    return topics, sorted(chunks)


def chunk_messages(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(connection, message) of the chunk at a place."""
    f.seek(at)
    n = struct.unpack("<I", f.read(4))[0]
    h = fields(f.read(n))
    data = f.read(struct.unpack("<I", f.read(4))[0])
    how = h["compression"]
    if how not in (b"none", b"bz2"):
        raise ValueError(f"chunks compressed by {how.decode()} can't be read")
    for g, message, _ in records(bz2.decompress(data) if how == b"bz2" else data):
        if g["op"][0] == MESSAGE:
            yield struct.unpack("<I", g["conn"])[0], message


def events(message: bytes) -> np.ndarray:
    """The events of an array message: a header with a name, the sensor's size, and the events."""
    name = struct.unpack_from("<I", message, 12)[0]
    n = struct.unpack_from("<I", message, 24 + name)[0]
    return np.frombuffer(message, EVENT, n, 28 + name)


@dataclass
class Chunk(ds.InputPartition):
    path: str
    at: int
    topics: dict[int, str]

    def __post_init__(self):
        super().__init__((self.path, self.at))


class BagReader(ds.DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names, self.address, self.topic = schema.names, options["path"], options.get("topic")
        self.lo, self.hi = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters):
        """Bounds of ``t_ns``; Spark still applies all filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t_ns",):
                if type(f) in (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo):
                    self.lo = max(self.lo, f.value)
                if type(f) in (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo):
                    self.hi = min(self.hi, f.value)
            yield f

    def _chunks(self, found: tuple[str, int]) -> list[Chunk]:
        path, size = found
        system, _ = storage.at(self.address)
        with system.open_input_file(path) as f:
            topics, chunks = index(f, size)
        wanted = {c: t for c, (t, kind) in topics.items() if kind == EVENT_ARRAY and self.topic in (None, t)}
        return [Chunk(path, at, wanted) for at, first, last in chunks if wanted and last >= self.lo and first <= self.hi]

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            out = [c for some in pool.map(self._chunks, storage.listing(self.address, SUFFIXES)) for c in some]
        return out or [Chunk("", 0, {})]

    def read(self, partition: Chunk):
        if not partition.path:
            return
        system, _ = storage.at(self.address)
        with system.open_input_file(partition.path) as f:
            for conn, message in chunk_messages(f, partition.at):
                if conn in partition.topics:
                    e = events(message)
                    n = len(e)
                    t = e["secs"].astype(np.int64) * 10**9 + e["nsecs"]
                    columns = {
                        "file": lambda: pa.array([partition.path.rpartition("/")[2]] * n, pa.string()),  # noqa: B023
                        "topic": lambda: pa.array([partition.topics[conn]] * n, pa.string()),  # noqa: B023
                        "t_ns": lambda: pa.array(t),  # noqa: B023
                    } | {c: lambda c=c: pa.array(e[c].astype(np.int32)) for c in "xyp"}  # noqa: B023
                    yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], list(self.names))


# ------------------------------------------------------------ writing
def _record(header: dict[str, bytes], data: bytes) -> bytes:
    body = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in header.items())
    return struct.pack("<I", len(body)) + body + struct.pack("<I", len(data)) + data


def _stamp(t_ns: int) -> bytes:
    return struct.pack("<II", *divmod(t_ns, 10**9))


@dataclass
class BagWriter(storage.StagedWriter):
    topic: str = "/dvs/events"
    chunk: int = 10_000
    compression: str = "none"
    suffix: str = ".bag"
    messages: int = 16
    bag_bytes: int = 64 << 20

    def _message(self, k: int, e: np.ndarray, t: np.ndarray) -> bytes:
        head = struct.pack("<I", k) + _stamp(int(t[-1])) + struct.pack("<I", 0) + struct.pack("<III", int(e["y"].max()) + 1, int(e["x"].max()) + 1, len(e))
        return head + e.tobytes()

    def write(self, iterator):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), self.attempt()
        connection = _record({"op": bytes([CONNECTION]), "conn": struct.pack("<I", 0), "topic": self.topic.encode()}, b"".join(struct.pack("<I", len(v)) + v for v in (b"topic=" + self.topic.encode(), b"type=" + EVENT_ARRAY.encode())))
        parts, infos, held, names, rows, last = [], [], [], [], 0, -1
        at = start = len(VERSION) + 4096

        def flush(messages: list[tuple[np.ndarray, np.ndarray]]) -> None:
            nonlocal at
            body = connection + b"".join(_record({"op": bytes([MESSAGE]), "conn": struct.pack("<I", 0), "time": _stamp(int(t[-1]))}, self._message(k, e, t)) for k, (e, t) in enumerate(messages))
            stored = bz2.compress(body) if self.compression == "bz2" else body
            raw = _record({"op": bytes([CHUNK]), "compression": self.compression.encode(), "size": struct.pack("<I", len(body))}, stored)
            # an index of messages follows each chunk; readers of whole chunks pass over it
            raw += _record({"op": bytes([INDEX]), "ver": struct.pack("<I", 1), "conn": struct.pack("<I", 0), "count": struct.pack("<I", 0)}, b"")
            info = {"op": bytes([CHUNK_INFO]), "ver": struct.pack("<I", 1), "chunk_pos": struct.pack("<Q", at), "start_time": _stamp(int(messages[0][1][0])), "end_time": _stamp(int(messages[-1][1][-1])), "count": struct.pack("<I", 1)}
            infos.append(_record(info, struct.pack("<II", 0, len(messages))))
            parts.append(raw)
            at += len(raw)

        def close() -> None:
            """Write what is held as one bag: its header says where the index begins."""
            nonlocal at
            head = _record({"op": bytes([BAG_HEADER]), "index_pos": struct.pack("<Q", at), "conn_count": struct.pack("<I", 1), "chunk_count": struct.pack("<I", len(infos))}, b"")
            size = struct.unpack_from("<I", head)[0]
            head = head[: 4 + size] + struct.pack("<I", 4096 - 8 - size) + b" " * (4096 - 8 - size)  # filled up, so that it can be rewritten
            name = f"{attempt}/part-{part:05d}-{len(names):05d}-{attempt[:8]}.bag"
            with self.open(name) as out:
                for raw in [VERSION, head, *parts, connection, *infos]:
                    out.write(raw)
            names.append(name)
            parts.clear()
            infos.clear()
            at = start

        for batch in iterator:
            t = batch.column("t_ns").to_numpy()
            if len(t) and (t[0] < last or (np.diff(t) < 0).any()):
                raise ValueError("events are to be sorted by time within partitions")
            e = np.zeros(len(t), EVENT)
            e["secs"], e["nsecs"] = np.divmod(t, 10**9)
            for c in "xyp":
                e[c] = batch.column(c).to_numpy()
            rows, last = rows + len(t), int(t[-1]) if len(t) else last
            held += [(e[k : k + self.chunk], t[k : k + self.chunk]) for k in range(0, len(t), self.chunk)]
            while len(held) >= self.messages:
                flush(held[: self.messages])
                held = held[self.messages :]
                if at >= self.bag_bytes:
                    close()
        if held:
            flush(held)
        if parts:
            close()
        return storage.Written(names, rows)


class BagEvents(ds.DataSource):
    @classmethod
    def name(cls):
        return "bag_events"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return BagReader(schema, self.options)

    def writer(self, schema, overwrite):
        o = self.options
        return BagWriter(o["path"], overwrite, topic=o.get("topic", "/dvs/events"), chunk=int(o.get("chunk", 10_000)), compression=o.get("compression", "none"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BagEvents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
