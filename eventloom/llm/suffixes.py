"""Repeated byte strings by a distributed, sparse suffix array.

A string of ``window`` bytes counts as repeated where it also starts earlier: in a row with a smaller id,
or earlier in the same row. Every byte that a repeated string covers is removed.

*Suffixes.* Not every suffix has to be sorted. In each window the lead (``LEAD`` bytes) with the smallest hash, the
leftmost of equal ones, is the window's anchor; equal windows have equal anchors at equal
places, so only suffixes that begin at anchors, about one byte in 39, take part. A suffix carries what its windows
cover: the bytes behind the anchor, and those before it.

*Partitioning.* Splitters, quantiles of the leads in a sample, cut the order of suffixes into
ranges of about ``RANGE_BYTES``. Each task first sorts what it has read; of equal suffixes only the
earliest travels, so a text that fills a third of the rows arrives once per task. A lead so common that it spans
several ranges is spread over them by the rest of the suffix.

*Ranges.* Suffixes are sorted locally by multikey quicksort, eight bytes as a character. Of equal ones all but
the earliest are repeated whole. Those left that share their lead with another are told apart
window by window: the windows' suffixes are sorted in the same way, to the depth of a window, and every one but the first of its run is
repeated. This is exact on the bytes.

*Boundaries.* Windows of leads that span several ranges may recur in another range. The earliest of each in
every range is compared with those of the other ranges by a 128-bit hash.

*Nulls and ties.* Null texts are empty. Rows are ordered by id, nulls first, and rows of equal id as they stand
in the files. Texts of any length are worked on in parts that overlap by a window; a text shorter than a window has no
repeated string. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import words
from .strings import eights, multikey_sort

LEAD = 24
#: Bytes of suffixes in a range, at most of the order of this.
RANGE_BYTES = 12 << 20
#: Bytes of text from which splitters are taken, and leads of them that reach the driver.
SAMPLE_BYTES, SAMPLE_LEADS = 32 << 20, 1 << 16
#: Suffixes that a task sorts at once before they travel; windows that are sorted at once.
UNIT, WINDOWS = 1 << 16, 1 << 17
PART = 1 << 20  # bytes of text in which anchors are sought at once
FIRST_ID = -(1 << 63)  # stands for a null id


def _up(n: int) -> int:
    return -(-n // 8) * 8


# ------------------------------------------------------------ suffixes
class Suffixes:
    """Suffixes at anchors: ``bytes``, each row what lies behind the anchor, filled up with zeros, and then, at the
    right end, what lies before it; ``right`` and ``left``, the lengths of both; the row's ``id``
    and number ``row``; ``at``, the place of the first window. In order of age."""

    def __init__(self, text: np.ndarray, right: np.ndarray, left: np.ndarray, ids: np.ndarray, row: np.ndarray, at: np.ndarray, window: int):
        self.bytes, self.right, self.left, self.id, self.row, self.at, self.window = text, right, left, ids, row, at, window

    def __len__(self) -> int:
        return len(self.row)

    @property
    def last(self) -> np.ndarray:
        """The place of the last window."""
        return self.at + self.left.astype(np.int64) + self.right - self.window

    def take(self, which: np.ndarray) -> Suffixes:
        return Suffixes(self.bytes[which], self.right[which], self.left[which], self.id[which], self.row[which], self.at[which], self.window)

    @staticmethod
    def joined(some: list[Suffixes]) -> Suffixes:
        """All of ``some``, which is emptied."""
        out = Suffixes(*(np.concatenate([getattr(s, k) for s in some]) for k in ("bytes", "right", "left", "id", "row", "at")), some[0].window)
        some.clear()
        return out.take(np.lexsort((out.at, out.row, out.id)))

    def mask(self) -> np.ndarray:
        behind = _up(self.window)
        k = np.arange(self.bytes.shape[1])
        return np.where(k < behind, k < self.right[:, None], k >= self.bytes.shape[1] - self.left[:, None].astype(np.int64))

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, whether it differs from the one before, whether its lead does)."""
        chars = self.bytes.view(">u8")
        sizes = self.right.astype(np.uint64) << np.uint64(8) | self.left
        at_depth = {LEAD // 8: np.ones(len(self), bool)}
        columns = [lambda i, k=k: chars[i, k].astype(np.uint64) for k in range(chars.shape[1])]
        order, first = multikey_sort(len(self), [*columns, lambda i: sizes[i]], at_depth)
        return order, first, at_depth[LEAD // 8]

    def lead(self) -> np.ndarray:
        return np.ascontiguousarray(self.bytes[:, :LEAD]).view(f"S{LEAD}")[:, 0]

    def pack(self) -> bytes:
        return np.int64(len(self)).tobytes() + b"".join(x.tobytes() for x in (self.id, self.row, self.at, self.right, self.left)) + self.bytes[self.mask()].tobytes()

    @staticmethod
    def unpack(raw: bytes, window: int) -> Suffixes:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at, got = 8, []
        for kind in (np.int64, np.int64, np.int64, np.uint8, np.uint8):
            got.append(np.frombuffer(raw, kind, n, at))
            at += got[-1].nbytes
        ids, row, place, right, left = got
        out = Suffixes(np.zeros((n, _up(window) + _up(window - LEAD)), np.uint8), right, left, ids, row, place, window)
        out.bytes[out.mask()] = np.frombuffer(raw, np.uint8, offset=at)
        return out


def anchors(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of texts that end at ``ends`` and lie one behind the other at the front of ``data``."""
    n = int(ends[-1]) if len(ends) else 0
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    e = eights(data[: n + 8]).astype(np.uint64)
    m = n - LEAD + 1
    h = e[:m] * np.uint64(0x9E3779B97F4A7C15)
    h += e[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += e[16 : m + 16] * np.uint64(0x165667B19E3779F9)
    low = np.uint64((1 << 22) - 1)
    least = (words.mix64(h) & ~low) | np.arange(m, dtype=np.uint64)
    span, want = 1, window - LEAD + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if want > span:
        least = np.minimum(least[: span - want], least[want - span :])
    anchor = (least & low).astype(np.int64)  # of the window at each place
    inside = np.zeros(len(anchor) + 1, np.int32)
    start, stop = np.concatenate([[0], ends[:-1]]), ends - window + 1
    whole = stop > start
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, stop[whole], -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(edge)
    last = np.append(begin[1:], len(anchor)) - 1
    keep = inside[begin]
    return anchor[begin[keep]], begin[keep], last[keep]


def _parts(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, ends, numbers of the texts, place of the first byte in its text): texts of a part together, long ones in overlapping parts."""
    k = 0
    for data, ends in words.blocks(texts, PART):
        if len(data) <= 2 * PART:
            yield data[:-8], ends, np.arange(k, k + len(ends)), 0
        else:
            for at in range(0, int(ends[-1]) - window + 1, PART):
                some = data[at : min(at + PART + window - 1, int(ends[-1]))]
                yield some, np.array([len(some)]), np.array([k]), at
        k += len(ends)


def suffixes(texts: pa.Array, ids: np.ndarray, rows: np.ndarray, window: int) -> Iterator[Suffixes]:
    behind, before = _up(window), _up(window - LEAD)
    for data, ends, which, base in _parts(texts, window):
        padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(behind + 8, np.uint8)])
        m, a, b = anchors(padded[before:], ends, window)
        if not len(m):
            continue
        right, left = b + window - m, m - a
        view = np.lib.stride_tricks.as_strided(padded, (len(padded) - behind + 1, behind), (1, 1))
        text = np.empty((len(m), behind + before), np.uint8)
        text[:, :behind] = view[m + before]
        text[:, behind:] = view[m][:, :before]
        of = which[np.searchsorted(ends, a, "right")]
        start = np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, a, "right")]
        out = Suffixes(text, right.astype(np.uint8), left.astype(np.uint8), ids[of], rows[of], a - start + base, window)
        text[~out.mask()] = 0
        yield out


# ------------------------------------------------------------ tasks
SPAN = "row long, first int, last int"
OUT = SPAN + ", id long, w1 long, w2 long"
EMPTY = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("id", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])


def _read(batch: pa.RecordBatch, window: int) -> Iterator[Suffixes]:
    ids = batch.column("id").fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
    yield from suffixes(batch.column("text"), ids, batch.column("row").to_numpy(), window)


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, those that adjoin in one row as one."""
    by = np.lexsort((first, row))
    row, first, last = row[by], first[by], last[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], first[at], last[np.append(at[1:], len(row)) - 1] if len(at) else last


def _to_ranges(window: int, splitters: np.ndarray, n_ranges: int):
    """Batches of texts to packed suffixes by range: (range, size, suffixes), and runs of windows settled here: (range, null, runs)."""
    schema = pa.schema([("range", pa.int32()), ("size", pa.int64()), ("cell", pa.binary())])

    def flush(some: list[Suffixes]) -> pa.RecordBatch:
        s = Suffixes.joined(some)
        order, first, _ = s.sort()
        gone = order[~first]
        s, settled = s.take(order[first]), _merged(s.row[gone], s.at[gone], s.last[gone])
        lead = s.lead()
        low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
        to = high.copy()
        hot = np.flatnonzero(high - low > 1)
        if len(hot):
            chars = s.bytes[hot].view("<u8")
            h = s.right[hot].astype(np.uint64) << np.uint64(8) | s.left[hot]
            for k in range(chars.shape[1]):
                h = words.mix64(h * np.uint64(0x9E3779B97F4A7C15) + chars[:, k])
            to[hot] = low[hot] + 1 + (h % (high[hot] - low[hot]).astype(np.uint64)).astype(np.int64)
        cells = []
        cuts = np.flatnonzero(np.diff(np.sort(to), prepend=-1))
        by = np.argsort(to, kind="stable")
        for p, q in zip(cuts, np.append(cuts[1:], len(by))):
            raw = s.take(by[p:q]).pack()
            cells.append((int(to[by[p]]), len(raw), pa.compress(raw, "zstd", asbytes=True)))
        if len(settled[0]):
            cells.append((int(settled[0][0]) % n_ranges, None, np.concatenate(settled).astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*cells), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.take_over("suffixes")
        some, n = [], 0
        for batch in batches:
            for s in _read(batch, window):
                some.append(s)
                n += len(s)
                if n >= UNIT:
                    yield flush(some)
                    n = 0
        if n:
            yield flush(some)

    return run


def _windows(s: Suffixes, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of distinct suffixes (in order of age), and the earliest of each window of hot ones."""
    window, behind = s.window, _up(s.window)
    before = s.bytes.shape[1] - behind
    text = np.zeros((len(s), before + behind + 16), np.uint8)
    text[:, :before] = s.bytes[:, behind:]
    text[:, before : before + behind] = s.bytes[:, :behind]
    each = (s.last - s.at + 1).astype(np.int64)
    of = np.repeat(np.arange(len(s)), each)
    k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    place = of * text.shape[1] + before - s.left[of].astype(np.int64) + k
    e = eights(text.ravel())
    keep = [np.uint64((1 << 64) - 1 if (j + 1) * 8 <= window else (1 << 64) - (1 << 8 * (8 - window % 8))) for j in range(behind // 8)]
    columns = [lambda i, j=j: e[place[i] + 8 * j].astype(np.uint64) & keep[j] for j in range(behind // 8)]
    order, first = multikey_sort(len(of), columns)
    again = np.zeros(len(of), bool)
    again[order[~first]] = True
    at = np.flatnonzero(again)
    yield _spans(*_merged(s.row[of[at]], s.at[of[at]] + k[at], s.at[of[at]] + k[at]))
    asked = np.flatnonzero(~again & hot[of])
    if len(asked):
        h1, h2 = np.full(len(asked), 1, np.uint64), np.full(len(asked), 2, np.uint64)
        for column in columns:
            x = column(asked)
            h1, h2 = words.mix64(h1 * np.uint64(0x9E3779B97F4A7C15) + x), words.mix64((h2 ^ x) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        o, start = of[asked], (s.at[of[asked]] + k[asked]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.row[o], start, start, s.id[o], h1.view(np.int64), h2.view(np.int64))], schema=EMPTY)


def _spans(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), none, none, none], schema=EMPTY)


def _settle(window: int, splitters: np.ndarray):
    """The packed suffixes of a range to rows of ``OUT``."""
    several = np.unique(splitters[1:][splitters[1:] == splitters[:-1]]) if len(splitters) else splitters

    def run(table: pa.Table) -> pa.Table:
        words.take_over("suffixes")
        out, some = [], []
        for size, cell in zip(table.column("size").to_pylist(), table.column("cell").to_pylist()):
            if size is None:
                out.append(_spans(*np.frombuffer(cell, np.int64).reshape(3, -1)))
            else:
                some.append(Suffixes.unpack(pa.decompress(cell, size, "zstd", asbytes=True), window))
        del table
        if some:
            s = Suffixes.joined(some)
            order, first, lead = s.sort()
            gone = order[~first]
            out.append(_spans(*_merged(s.row[gone], s.at[gone], s.last[gone])))
            group = np.cumsum(lead)[first]  # of each distinct suffix, in order
            s = s.take(order[first])
            hot = np.isin(s.lead(), several)
            left = np.flatnonzero((np.bincount(group)[group] > 1) | hot)
            ends = np.cumsum((s.last - s.at + 1)[left])
            while len(left):
                # whole groups of a lead, about so many windows
                n = max(1, int(np.searchsorted(ends, ends[0] + WINDOWS)))
                n = int(np.searchsorted(group[left], group[left[n - 1]], "right"))
                t = left[:n]
                t = t[np.lexsort((s.at[t], s.row[t], s.id[t]))]
                out += _windows(s.take(t), hot[t])
                left, ends = left[n:], ends[n:]
        return pa.Table.from_batches(out, EMPTY)

    return run


def _cover(window: int):
    """Texts with their runs of repeated windows to the maximal runs of bytes to remove, and what is left."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.take_over("suffixes")
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            spans, kept, sizes = [], [], []
            for k, runs in enumerate(batch.column("runs")):
                raw = texts[k].as_buffer() if texts[k].is_valid else b""
                own = []
                if runs.is_valid:
                    first, last = (runs.values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                    stop = np.maximum.accumulate(last + window)
                    new = np.ones(len(first), bool)
                    new[1:] = first[1:] > stop[:-1]
                    at = np.flatnonzero(new)
                    own = list(zip(first[at].tolist(), stop[np.append(at[1:], len(first)) - 1].tolist()))
                raw, cut = memoryview(raw), [0, *(x for o in own for x in o), len(raw)]
                kept.append(b"".join(raw[p:q] for p, q in zip(cut[::2], cut[1::2])))
                spans.append([{"start": p, "stop": q} for p, q in own])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


# ------------------------------------------------------------ the operator
def sampled_splitters(rows: DataFrame, total: int, window: int, n_ranges: int) -> np.ndarray:
    """Quantiles of the leads of a sample of the rows, sorted; a common lead may be several of them."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    stride = max(1, int(share * total / (window - LEAD + 1) * 2 / SAMPLE_LEADS))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _read(batch, window):
                order, first, _ = s.sort()
                some = s.take(order[first][::stride]).bytes[:, :LEAD].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([some[k : k + LEAD] for k in range(0, len(some), LEAD)], pa.binary())], ["lead"])

    got = np.sort(np.array([r["lead"] for r in rows.sample(share, seed=1).mapInArrow(leads, "lead binary").collect()], f"S{LEAD}"))
    return got[(np.arange(1, n_ranges) * len(got)) // n_ranges] if len(got) else got


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """(row, first, last): runs of repeated windows of ``rows`` (row, id, text)."""
    spark = rows.sparkSession
    C.small_batches(spark)
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_ranges = max(1, -(-total * 7 // 2 // RANGE_BYTES))
    splitters = sampled_splitters(rows, total, window, n_ranges) if n_ranges > 1 else np.zeros(0, f"S{LEAD}")
    cells = rows.mapInArrow(_to_ranges(window, splitters, n_ranges), "range int, size long, cell binary")
    found = C.saved(cells.groupBy("range").applyInArrow(_settle(window, splitters), OUT), "windows")
    earliest = W.partitionBy("w1", "w2").orderBy("id", "row", "first")  # a row of each range at most
    across = found.where("w1 is not null").withColumn("n", F.row_number().over(earliest)).where("n > 1")
    return found.where("w1 is null").select("row", "first", "last").unionByName(across.select("row", "first", "last"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (maximal removed runs of bytes, ``stop`` exclusive) and
    ``kept``, the remaining bytes. ``docs`` is to be read from files."""
    if not 2 * LEAD <= window <= 255:
        raise ValueError(f"window must lie between {2 * LEAD} and 255")
    rows, row = C.numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = rows.withColumnRenamed(row, "row")
    runs = repeated_windows(rows, window).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    met = rows.join(runs.hint("shuffle_hash"), "row", "left").select("id", "text", "runs")
    out = met.mapInArrow(_cover(window), "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
