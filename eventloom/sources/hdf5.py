"""HDF5 groups as tables: ``spark.read.format("hdf5")`` and ``df.write.format("hdf5")``.

The datasets of a group with as many rows as each other are the columns: one-dimensional ones as numbers, two-dimensional ones as
arrays of numbers, those of more dimensions (images) as bytes. Two columns are added: ``file``, the
file's name, and ``row``, the 0-based row in its group.

Options: ``path`` (a file, or a folder of .h5 and .hdf5 files), ``group``, ``rows`` (rows in a partition, 2^20), ``sorted``
(a column by which every file ascends, with which filters prune partitions).

*Columns.* Only datasets that the schema names are read: pass ``.schema("timestamps long")`` to read one of many.

*Filters.* Comparisons of the ``sorted`` column and of ``row`` with constants are pushed down
(``spark.sql.python.filterPushdown.enabled``): by binary search, which reads a value or a chunk a step, the first and
last row that can hold are found in each file, and partitions lie between them. Spark applies the filters once more.

*Files.* The driver reads the layout of each file, some kilobytes; tasks read the bytes of their rows. Read are files of the
classic layout (version 0 or 1 of the superblock): contiguous and chunked datasets of integers, floats and enumerations, plain
or with the shuffle and deflate filters. Written are chunked datasets with both filters, several files a task if it has ``rows`` rows or more;
``chunk`` is the number of rows in a chunk, and bytes are images of the option ``shape`` ("480,640"). Nulls can't be written.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from . import storage

# Fixed values of the format: message numbers, filters, signature, the address that stands for none.
DATASPACE, DATATYPE, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE = 1, 2
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1

SUFFIXES = (".h5", ".hdf5")


# ------------------------------------------------------------ layout
@dataclass
class Dataset:
    """Where the rows of a dataset lie: pieces (first row, rows, address, stored bytes, filters left out), in order."""

    dtype: str
    shape: tuple[int, ...]
    pieces: list[tuple[int, int, int, int, int]]
    filters: list[tuple[int, list[int]]] = field(default_factory=list)

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


class Layout:
    """The groups and datasets of an open file."""

    def __init__(self, f):
        self.f = f
        head = self._at(0, 96)
        if head[:8] != SIGNATURE or head[8] > 1 or head[13:15] != b"\x08\x08":
            raise ValueError("not an HDF5 file of the classic layout")
        entry = 24 + (4 if head[8] else 0) + 32
        self.root = struct.unpack("<Q", self._at(entry + 8, 8))[0]

    def _at(self, address: int, size: int) -> bytes:
        self.f.seek(address)
        return self.f.read(size)

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        version, _, count, _, size = struct.unpack("<BBHII", self._at(address, 12))
        if version != 1:
            raise ValueError("only object headers of version 1 are read")
        blocks = [(address + 16, size)]
        while blocks:
            start, size = blocks.pop(0)
            raw, p = self._at(start, size), 0
            while p + 8 <= size and count > 0:
                kind, n = struct.unpack("<HH", raw[p : p + 4])
                body = raw[p + 8 : p + 8 + n]
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                yield kind, body
                p, count = p + 8 + n, count - 1

    def _nodes(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a tree of groups or chunks."""
        head = self._at(address, 24)
        level, used = head[5], struct.unpack("<H", head[6:8])[0]
        raw = self._at(address + 24, used * (key + 8))
        for k in range(used):
            at = k * (key + 8)
            child = struct.unpack("<Q", raw[at + key : at + key + 8])[0]
            if level:
                yield from self._nodes(child, key)
            else:
                yield raw[at : at + key], child

    def members(self, address: int) -> dict[str, int]:
        """Names in a group to the addresses of their headers; of a dataset, nothing."""
        table = next((b for k, b in self._messages(address) if k == SYMBOLS), None)
        if table is None:
            return {}
        tree, heap = struct.unpack("<QQ", table[:16])
        names = struct.unpack("<Q", self._at(heap + 24, 8))[0]
        out = {}
        for _, leaf in self._nodes(tree, 8):
            n = struct.unpack("<H", self._at(leaf + 6, 2))[0]
            for k in range(n):
                name, header = struct.unpack("<QQ", self._at(leaf + 8 + 40 * k, 16))
                out[self._at(names + name, 256).split(b"\0")[0].decode()] = header
        return out

    def dataset(self, address: int) -> Dataset | None:
        parts = dict(self._messages(address))
        if LAYOUT not in parts:
            return None
        space, kind, layout = parts[DATASPACE], parts[DATATYPE], parts[LAYOUT]
        at = 8 if space[0] == 1 else 4
        shape = struct.unpack(f"<{space[1]}Q", space[at : at + 8 * space[1]])
        code, order, size = kind[0] & 15, "<" if not kind[1] & 1 else ">", struct.unpack("<I", kind[4:8])[0]
        if code not in (0, 1, 8) or layout[0] != 3 or not shape:
            return None  # text, references, single values
        letter = "f" if code == 1 else "i" if code == 8 or kind[1] & 8 else "u"
        out = Dataset(f"{order}{letter}{size}", shape, [], self._filters(parts.get(FILTERS)))
        if layout[1] == 1:
            address, stored = struct.unpack("<QQ", layout[2:18])
            if address != NOWHERE and shape[0]:
                out.pieces.append((0, shape[0], address, stored, 0))
        elif layout[1] == 2:
            rank, tree = layout[2], struct.unpack("<Q", layout[3:11])[0]
            chunk = struct.unpack(f"<{rank}I", layout[11 : 11 + 4 * rank])
            if chunk[1:-1] != shape[1:]:
                raise ValueError("chunks of parts of rows can't be read")
            if tree != NOWHERE:
                for key, child in self._nodes(tree, 8 + 8 * rank):
                    stored, left_out, first = struct.unpack("<IIQ", key[:16])
                    out.pieces.append((first, chunk[0], child, stored, left_out))
            out.pieces.sort()
        else:
            raise ValueError("compact datasets can't be read")
        return out

    @staticmethod
    def _filters(raw: bytes | None) -> list[tuple[int, list[int]]]:
        out, p = [], 0
        if raw:
            p = 8 if raw[0] == 1 else 2
            for _ in range(raw[1]):
                kind, p = struct.unpack("<H", raw[p : p + 2])[0], p + 2
                name = 0
                if raw[0] == 1 or kind >= 256:
                    name, p = struct.unpack("<H", raw[p : p + 2])[0], p + 2
                n = struct.unpack("<H", raw[p + 2 : p + 4])[0]
                p += 4 + (-(-name // 8) * 8 if raw[0] == 1 else name)
                out.append((kind, list(struct.unpack(f"<{n}I", raw[p : p + 4 * n]))))
                p += 4 * n + (4 if raw[0] == 1 and n % 2 else 0)
        return out

    def group(self, path: str) -> dict[str, Dataset]:
        at = self.root
        for name in filter(None, path.split("/")):
            at = self.members(at)[name]
        found = {name: self.dataset(header) for name, header in self.members(at).items()}
        return {name: d for name, d in found.items() if d is not None}


def _decoded(raw: bytes, d: Dataset, left_out: int) -> bytes:
    for k, (kind, _) in reversed(list(enumerate(d.filters))):
        if left_out >> k & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == SHUFFLE:
            size = np.dtype(d.dtype).itemsize
            raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
        else:
            raise ValueError(f"filter {kind} can't be read")
    return raw


class Rows:
    """Rows of a dataset of an open file; the last chunk read is kept."""

    def __init__(self, f, d: Dataset):
        self.f, self.d = f, d
        self.firsts = [p[0] for p in d.pieces]
        self.chunk = functools.lru_cache(maxsize=1)(self._chunk)

    def _chunk(self, k: int) -> bytes:
        _, _, address, stored, left_out = self.d.pieces[k]
        self.f.seek(address)
        return _decoded(self.f.read(stored), self.d, left_out)

    def read(self, a: int, b: int) -> np.ndarray:
        """Rows a to b, zeros where nothing is stored."""
        size, out, p = self.d.row_bytes, [], a
        k = max(0, int(np.searchsorted(self.firsts, a, "right")) - 1)
        for first, n, address, _, _ in self.d.pieces[k:]:
            lo, hi = max(a, first), min(b, first + n)
            if lo >= b:
                break
            if lo < hi:
                out.append(bytes((lo - p) * size))
                if self.d.filters:
                    out.append(self.chunk(k)[(lo - first) * size : (hi - first) * size])
                else:
                    self.f.seek(address + (lo - first) * size)
                    out.append(self.f.read((hi - lo) * size))
                p = hi
            k += 1
        out.append(bytes((b - p) * size))
        return np.frombuffer(b"".join(out), self.d.dtype).reshape(b - a, *self.d.shape[1:])

    def lower_bound(self, value, strict: bool) -> int:
        """The first row with at least ``value`` (``strict``: more than it), of ascending rows."""
        lo, hi = 0, self.d.shape[0]
        while lo < hi:
            mid = (lo + hi) // 2
            x = self.read(mid, mid + 1)[0]
            lo, hi = (lo, mid) if (x > value if strict else x >= value) else (mid + 1, hi)
        return lo


# ------------------------------------------------------------ reading
def _spark_type(d: Dataset) -> T.DataType:
    kind = np.dtype(d.dtype)
    if len(d.shape) > 2:
        return T.BinaryType()
    if kind.kind == "f":
        one = T.FloatType() if kind.itemsize == 4 else T.DoubleType()
    else:  # an unsigned number gets a type that holds it
        bits = kind.itemsize * (2 if kind.kind == "u" else 1)
        one = {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType()}.get(bits, T.LongType())
    return one if len(d.shape) == 1 else T.ArrayType(one)


@dataclass
class Part(ds.InputPartition):
    path: str
    first: int
    stop: int

    def __post_init__(self):
        super().__init__((self.path, self.first, self.stop))


class Hdf5Reader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.address, self.group = schema, options["path"], options.get("group", "/")
        self.rows, self.sorted = int(options.get("rows", 1 << 20)), options.get("sorted")
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters):
        """Bounds of the sorted column and of ``row``; Spark still applies all filters."""
        ops = {ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.EqualTo: "="}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in ("row", self.sorted):
                self.bounds.append((f.attribute[0], ops[type(f)], f.value))
            yield f

    def _range(self, path: str) -> tuple[int, int]:
        """The first row and the one behind the last that the bounds allow."""
        system, _ = storage.at(self.address)
        with system.open_input_file(path) as f:
            group = Layout(f).group(self.group)
            a, b = 0, _height(group)
            for column, op, value in self.bounds:
                if column == "row":
                    first = lambda strict: int(np.floor(value)) + 1 if strict else int(np.ceil(value))  # noqa: B023, E731
                else:
                    first = lambda strict: Rows(f, group[column]).lower_bound(value, strict)  # noqa: B023, E731
                if op in (">", ">=", "="):
                    a = max(a, first(op == ">"))
                if op in ("<", "<=", "="):
                    b = min(b, first(op != "<"))
        return a, b

    def partitions(self):
        paths = [p for p, _ in storage.listing(self.address, SUFFIXES)]
        with ThreadPoolExecutor(16) as pool:
            ranges = list(pool.map(self._range, paths))
        out = [Part(p, k, min(b, k + self.rows)) for p, (a, b) in zip(paths, ranges) for k in range(a, b, self.rows)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part, together: int = 1 << 16):
        if not partition.path:
            return
        system, _ = storage.at(self.address)
        fields = self.schema.fields
        with system.open_input_file(partition.path) as f:
            group = Layout(f).group(self.group)
            columns = {x.name: Rows(f, group[x.name]) for x in fields if x.name in group}
            wide = max([1, *(c.d.row_bytes for c in columns.values())])
            step = max(1, min(together, (8 << 20) // wide))
            for a in range(partition.first, partition.stop, step):
                b = min(partition.stop, a + step)
                arrays = []
                for x in fields:
                    if x.name == "file":
                        arrays.append(pa.array([partition.path.rpartition("/")[2]] * (b - a)))
                    elif x.name == "row":
                        arrays.append(pa.array(np.arange(a, b)))
                    elif x.name in columns:
                        arrays.append(_arrow(columns[x.name].read(a, b), x.dataType))
                    else:
                        raise ValueError(f"{self.group} has no dataset {x.name}")
                yield pa.RecordBatch.from_arrays(arrays, [x.name for x in fields])


def _height(group: dict[str, Dataset]) -> int:
    return min((d.shape[0] for d in group.values()), default=0)


def _arrow(x: np.ndarray, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    to = to_arrow_type(kind)
    if isinstance(kind, T.BinaryType):
        return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
    if x.ndim == 1:
        return pa.array(x.astype(x.dtype.newbyteorder("="))).cast(to)
    flat = pa.array(x.astype(x.dtype.newbyteorder("=")).ravel()).cast(to.value_type)
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], flat).cast(to)


# ------------------------------------------------------------ writing
def _numpy(c: pa.ChunkedArray, shape: tuple[int, ...]) -> np.ndarray:
    if c.null_count:
        raise ValueError("HDF5 datasets hold no nulls")
    c = c.combine_chunks()
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), *shape)
    if pa.types.is_list(c.type):
        flat = c.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(c), len(flat) // max(1, len(c)))
    return c.to_numpy(zero_copy_only=False)


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


class Builder:
    """The bytes of a file, made from its end: what points comes behind what it points to, but for the first 96 bytes."""

    def __init__(self):
        self.parts, self.end = [bytes(96)], 96

    def add(self, raw: bytes) -> int:
        at, raw = self.end, raw + bytes(-len(raw) % 8)
        self.parts.append(raw)
        self.end += len(raw)
        return at

    def tree(self, kind: int, entries: list[tuple[bytes, int]], last: bytes, fan: int) -> int:
        """A tree over (key, child), of nodes of up to ``fan`` children."""
        level = 0
        while True:
            nodes, key = [], len(last)
            for k in range(0, max(1, len(entries)), fan):
                some = entries[k : k + fan]
                end = entries[k + fan][0] if k + fan < len(entries) else last
                body = b"".join(e + struct.pack("<Q", c) for e, c in some) + end
                body += bytes((fan + 1) * key + fan * 8 - len(body))
                nodes.append((some[0][0] if some else last, self.add(b"TREE" + struct.pack("<BBHQQ", kind, level, len(some), NOWHERE, NOWHERE) + body)))
            if len(nodes) == 1:
                return nodes[0][1]
            entries, level = nodes, level + 1

    def dataset(self, x: np.ndarray, chunk: int) -> int:
        x = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<")) if x.dtype != bool else x.astype("i1"))
        size, rank = x.dtype.itemsize, x.ndim
        chunk = max(1, min(chunk, len(x)))
        entries = []
        for k in range(0, len(x), chunk):
            raw = np.zeros((chunk, *x.shape[1:]), x.dtype)
            raw[: len(x) - k] = x[k : k + chunk]
            raw = zlib.compress(raw.view(np.uint8).reshape(-1, size).T.tobytes(), 1)
            entries.append((struct.pack(f"<IIQ{rank}Q", len(raw), 0, k, *[0] * rank), self.add(raw)))
        last = struct.pack(f"<IIQ{rank}Q", 0, 0, -(-len(x) // chunk) * chunk, *[0] * rank)
        tree = self.tree(1, entries, last, 64) if len(x) else NOWHERE
        space = struct.pack("<BBB5x", 1, rank, 0) + struct.pack(f"<{rank}Q", *x.shape)
        if x.dtype.kind == "f":
            bits = {4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}[size]
            kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits[0], 0, size, 0, 8 * size, *bits[1:])
        else:
            kind = struct.pack("<BBBBIHH", 0x10, 8 if x.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
        pipeline = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 0, 1, size) + struct.pack("<HHHHI4x", DEFLATE, 0, 0, 1, 1)
        layout = struct.pack("<BBBQ", 3, 2, rank + 1, tree) + struct.pack(f"<{rank + 1}I", chunk, *x.shape[1:], size)
        return self.add(_header(_message(DATASPACE, space), _message(DATATYPE, kind), _message(LAYOUT, layout), _message(FILTERS, pipeline)))

    def group(self, members: dict[str, int]) -> tuple[int, int, int]:
        """(header, tree, heap) of a group."""
        names, offsets = bytearray(8), {}
        for name in sorted(members):
            offsets[name] = len(names)
            names += name.encode() + b"\0"
            names += bytes(-len(names) % 8)
        data = self.add(bytes(names))
        heap = self.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, data))  # 1: no free space
        leaves, ordered = [], sorted(members, key=str.encode)
        for k in range(0, len(ordered), 8):
            some = ordered[k : k + 8]
            body = b"".join(struct.pack("<QQI4x16x", offsets[n], members[n], 0) for n in some)
            leaf = self.add(b"SNOD" + struct.pack("<BxH", 1, len(some)) + body + bytes(40 * (8 - len(some))))
            leaves.append((struct.pack("<Q", offsets[ordered[k - 1]] if k else 0), leaf))
        tree = self.tree(0, leaves, struct.pack("<Q", offsets[ordered[-1]] if ordered else 0), 32)
        return self.add(_header(_message(SYMBOLS, struct.pack("<QQ", tree, heap)))), tree, heap

    def file(self, path: str, columns: dict[str, np.ndarray], chunk: int) -> list[bytes]:
        here = self.group({n: self.dataset(x, chunk) for n, x in columns.items()})
        for name in reversed([p for p in path.split("/") if p]):
            here = self.group({name: here[0]})
        head = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0)
        head += struct.pack("<QQQQ", 0, NOWHERE, self.end, NOWHERE) + struct.pack("<QQI4xQQ", 0, here[0], 1, here[1], here[2])
        return [head, *self.parts[1:]]


@dataclass
class Hdf5Writer(storage.StagedWriter):
    group: str = "/"
    rows: int = 1 << 20
    chunk: int = 1 << 16
    shape: tuple[int, ...] = (-1,)
    suffix: str = ".h5"

    def write(self, iterator):
        from pyspark import TaskContext

        part, attempt, names, some, total = TaskContext.get().partitionId(), self.attempt(), [], [], 0

        def flush(t: pa.Table) -> None:
            name = f"{attempt}/part-{part:05d}-{len(names):05d}-{attempt[:8]}.h5"
            with self.open(name) as out:
                for raw in Builder().file(self.group, {c: _numpy(t.column(c), self.shape) for c in t.column_names}, self.chunk):
                    out.write(raw)
            names.append(name)

        held = 0
        for batch in iterator:
            some.append(batch)
            held, total = held + batch.num_rows, total + batch.num_rows
            while held >= self.rows:
                t = pa.Table.from_batches(some)
                flush(t.slice(0, self.rows))
                some, held = t.slice(self.rows).to_batches(), held - self.rows
        if held:
            flush(pa.Table.from_batches(some))
        return storage.Written(names, total)


class Hdf5(ds.DataSource):
    @classmethod
    def name(cls):
        return "hdf5"

    def schema(self):
        files = storage.listing(self.options["path"], SUFFIXES)
        if not files:
            raise ValueError(f"no HDF5 files in {self.options['path']}")
        system, _ = storage.at(self.options["path"])
        with system.open_input_file(files[0][0]) as f:
            group = Layout(f).group(self.options.get("group", "/"))
        return T.StructType([T.StructField(n, _spark_type(d)) for n, d in group.items()] + [T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])

    def reader(self, schema):
        return Hdf5Reader(schema, self.options)

    def writer(self, schema, overwrite):
        o = self.options
        shape = tuple(map(int, o.get("shape", "-1").split(",")))
        return Hdf5Writer(o["path"], overwrite, group=o.get("group", "/"), rows=int(o.get("rows", 1 << 20)), chunk=int(o.get("chunk", 1 << 16)), shape=shape)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Hdf5)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def rows_at(wanted: DataFrame, address: str, group: str, column: str) -> DataFrame:
    """The rows (file, row, ...) of ``wanted`` with ``column``, a dataset of images, read by seeking; no other image is read."""
    schema = T.StructType([*wanted.schema.fields, T.StructField(column, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = storage.at(address)
        paths = {p.rpartition("/")[2]: p for p, _ in storage.listing(address, SUFFIXES)}
        for batch in batches:
            images: list[bytes | None] = [None] * batch.num_rows
            files = np.array(batch.column("file").to_pylist())
            rows = batch.column("row").to_numpy()
            for name in np.unique(files):
                with system.open_input_file(paths[name]) as f:
                    data = Rows(f, Layout(f).group(group)[column])
                    which = np.flatnonzero(files == name)
                    for k in which[np.argsort(rows[which])]:
                        images[k] = data.read(int(rows[k]), int(rows[k]) + 1).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(images, pa.binary())], [*batch.schema.names, column])

    return wanted.mapInArrow(run, schema)
