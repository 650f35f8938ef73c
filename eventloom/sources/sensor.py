"""Raw files of an event sensor: 16-bit words that change a decoder's state (EVT 3.0).

A word holds its kind in its upper four bits. Some set the current row, time or base column; others give
events at the current state. Where a reader begins in the middle of a file it doesn't know that state, so reading takes two passes:

1. Every split of a file is summed up in one row: what it sets last, how far it moves the base column, how often its
   24-bit clock goes round.
2. A window over those rows (one for each split, in order) gives each split the state it starts with, and the
   splits are decoded in parallel, each as arrays.

Files start with lines of text that begin with ``%``; ``% first_us N`` gives the time at which the clock was zero (0 without it). The clock went
round where its upper part falls by more than half its range, so a file is to hold a time word at least every 8.3 seconds, as sensors write them.
Words of other kinds (triggers, vendors' own) are passed over; an odd last byte is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from . import storage

# Fixed values of the format: kinds of words.
ADDR_Y, ADDR_X, VECT_BASE_X, VECT_12, VECT_8, TIME_LOW, TIME_HIGH = 0x0, 0x2, 0x3, 0x4, 0x5, 0x6, 0x8
SUFFIXES = (".raw",)
EVENTS = "file string, place long, t_us long, x int, y int, p int"
STATE = "y int, low int, high int, first_high int, rounds long, base int, base_p int, moved int"


# ------------------------------------------------------------ words
def header(f) -> tuple[int, int]:
    """(bytes of the header, time at which the clock was zero) of an open file."""
    at, zero = 0, 0
    while True:
        f.seek(at)
        line = f.read(4096).split(b"\n")[0]
        if not line.startswith(b"%"):
            return at, zero
        if line.startswith(b"% first_us "):
            zero = int(line.split()[2])
        at += len(line) + 1


def _last(where: np.ndarray, value: np.ndarray, start: int) -> np.ndarray:
    """At each word the value of the last word in ``where`` up to it, ``start`` before the first."""
    at = np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))
    return np.where(at >= 0, value[at], start)


def _rounds(high: np.ndarray) -> np.ndarray:
    """How often the clock went round up to each of its upper parts."""
    return np.cumsum(np.concatenate([[0], np.diff(high) < -2048])) if len(high) else np.zeros(0, np.int64)


def summary(words: np.ndarray) -> dict:
    """What words do to the state; None for what they don't set."""
    kind, value = words >> 12, (words & 0xFFF).astype(np.int64)
    last = lambda k, bits: int(value[kind == k][-1]) & bits if (kind == k).any() else None
    high = value[kind == TIME_HIGH]
    base = np.flatnonzero(kind == VECT_BASE_X)
    after = kind[base[-1] :] if len(base) else kind
    moved = 12 * int((after == VECT_12).sum()) + 8 * int((after == VECT_8).sum())
    return {
        "y": last(ADDR_Y, 0x7FF),
        "low": last(TIME_LOW, 0xFFF),
        "high": int(high[-1]) if len(high) else None,
        "first_high": int(high[0]) if len(high) else None,
        "rounds": int(_rounds(high)[-1]) if len(high) else 0,
        "base": int(value[base[-1]] & 0x7FF) if len(base) else None,
        "base_p": int(value[base[-1]] >> 11) if len(base) else None,
        "moved": moved,
    }


def decode(words: np.ndarray, place: int, state: dict) -> dict[str, np.ndarray]:
    """The events of words (numbered from ``place``), from a state on; in order."""
    kind, value = words >> 12, (words & 0xFFF).astype(np.int64)
    high_at = kind == TIME_HIGH
    highs = value[high_at]
    rounds = np.zeros(len(words), np.int64)
    if len(highs):
        went = _rounds(np.concatenate([[state["high"]], highs]))[1:]
        rounds = np.concatenate([[0], went])[np.cumsum(high_at)]
    t = ((rounds + state["rounds"]) << 24) + (_last(high_at, value, state["high"]) << 12) + _last(kind == TIME_LOW, value, state["low"])
    y = _last(kind == ADDR_Y, value & 0x7FF, state["y"])
    based = kind == VECT_BASE_X
    base_p = _last(based, value >> 11, state["base_p"])
    step = np.where(kind == VECT_12, 12, np.where(kind == VECT_8, 8, 0))
    before = np.cumsum(step) - step
    base = _last(based, (value & 0x7FF) - before, state["base"]) + before
    single = np.flatnonzero(kind == ADDR_X)
    vector = np.flatnonzero(step)
    bits = (value[vector, None] >> np.arange(12) & 1).astype(bool) & (np.arange(12) < step[vector, None])
    row, bit = np.nonzero(bits)
    many = vector[row]
    at = np.concatenate([single, many])
    x = np.concatenate([value[single] & 0x7FF, base[many] + bit])
    p = np.concatenate([value[single] >> 11, base_p[many]])
    number = (at + place) * 16 + np.concatenate([np.zeros(len(single), np.int64), bit])
    by = np.argsort(number, kind="stable")
    return {"place": number[by], "t_us": t[at][by], "x": x[by], "y": y[at][by], "p": p[by]}


def encode(t: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Words for events in order of time (microseconds from the clock's zero): what changes, then the event."""
    n = len(t)
    if not n:
        return np.zeros(0, "<u2")
    high, low = t >> 12, t & 0xFFF
    ahead = np.diff(high, prepend=0)
    # time words on the way, so that none is more than half a round after the last
    steps = np.maximum(ahead > 0, -(-ahead // 2047))
    steps[0] = max(1, steps[0])
    of = np.repeat(np.arange(n), steps)
    k = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    on_way = np.minimum(high[of] - ahead[of] + 2047 * k, high[of])
    changed = lambda v: np.concatenate([[True], v[1:] != v[:-1]])
    parts = [
        (of, np.full(len(of), 0), TIME_HIGH << 12 | on_way & 0xFFF),
        (np.flatnonzero(changed(low)), 1, (TIME_LOW << 12 | low)[changed(low)]),
        (np.flatnonzero(changed(y)), 2, (ADDR_Y << 12 | y)[changed(y)]),
        (np.arange(n), 3, ADDR_X << 12 | p << 11 | x),
    ]
    event = np.concatenate([a for a, _, _ in parts])
    order = np.concatenate([np.broadcast_to(b, len(a)) for a, b, _ in parts])
    words = np.concatenate([w for _, _, w in parts]).astype("<u2")
    return words[np.lexsort((np.arange(len(words)), order, event))]


# ------------------------------------------------------------ reading
def _words(f, first: int, stop: int) -> np.ndarray:
    f.seek(first)
    raw = f.read(stop - first)
    return np.frombuffer(raw, "<u2", len(raw) // 2).astype(np.uint32)


def splits(spark: SparkSession, address: str, split_bytes: int) -> DataFrame:
    """(path, file, zero, k, origin, first, stop): stretches of words of every file, from lengths and headers."""
    system, _ = storage.at(address)
    files = []
    for path, size in storage.listing(address, SUFFIXES):
        with system.open_input_file(path) as f:
            origin, zero = header(f)
        files.append((path, path.rpartition("/")[2], zero, origin, size))
    rows = spark.createDataFrame(files, "path string, file string, zero long, origin long, size long").withColumn("n", F.ceil((F.col("size") - F.col("origin")) / split_bytes))
    rows = rows.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    first = F.col("origin") + F.col("k").cast("long") * split_bytes
    return rows.select("path", "file", "zero", "k", "origin", first.alias("first"), F.least(first + split_bytes, "size").alias("stop"))


def start_states(found: DataFrame) -> DataFrame:
    """Splits with what they do to the state, to splits with the state they start with."""
    before = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    # round the border between two splits the clock may go round as well
    across = F.when(F.col("first_high") - last("high") < -2048, 1).otherwise(0)
    rows = found.withColumn("own_rounds", F.col("rounds") + across)
    free = F.when(F.col("base").isNull(), F.col("moved")).otherwise(0)  # moves a base that an earlier split set
    rows = rows.withColumn("free", F.coalesce(F.sum(free).over(before), F.lit(0)))
    rows = rows.withColumn("set", F.col("base") + F.col("moved") - F.col("free"))
    zero = F.lit(0)
    return rows.select(
        "path", "file", "zero", "k", "origin", "first", "stop",
        F.coalesce(last("y"), zero).alias("y"),
        F.coalesce(last("low"), zero).alias("low"),
        F.coalesce(last("high"), zero).alias("high"),
        F.coalesce(F.sum("own_rounds").over(before), zero).alias("rounds"),
        (F.coalesce(last("set"), zero) + F.col("free")).cast("int").alias("base"),
        F.coalesce(last("base_p"), zero).alias("base_p"),
    )


def raw_events(spark: SparkSession, address: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Events (file, place, t_us, x, y, p) of the raw files of a folder; ``place`` ascends with the order in a file."""
    split_bytes = max(2, split_bytes // 2 * 2)
    plan = splits(spark, address, split_bytes)
    names = plan.columns

    def each(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        system, _ = storage.at(address)
        for batch in batches:
            for s in batch.to_pylist():
                with system.open_input_file(s["path"]) as f:
                    yield from make(f, s)

    def sum_up(f, s):
        yield pa.RecordBatch.from_pylist([s | summary(_words(f, s["first"], s["stop"]))], summed)

    def events(f, s, step: int = 1 << 20):
        state = {k: s[k] for k in ("y", "low", "high", "rounds", "base", "base_p")}
        for first in range(s["first"], s["stop"], step):
            words = _words(f, first, min(s["stop"], first + step))
            out = decode(words, (first - s["origin"]) // 2, state)
            got = summary(words)
            border = got["first_high"] is not None and got["first_high"] - state["high"] < -2048
            state["rounds"] += got["rounds"] + border
            moved = (state["base"] if got["base"] is None else got["base"]) + got["moved"]
            state |= {k: got[k] for k in ("y", "low", "high", "base_p") if got[k] is not None} | {"base": moved}
            n = len(out["place"])
            yield pa.RecordBatch.from_arrays([pa.array([s["file"]] * n, pa.string()), pa.array(out["place"]), pa.array(out["t_us"] + s["zero"]), *(pa.array(out[c].astype(np.int32)) for c in "xyp")], ["file", "place", "t_us", "x", "y", "p"])

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    summed = pa.schema([(n, kinds[k]) for n, k in plan.dtypes] + [(c.split()[0], kinds[c.split()[1].replace("long", "bigint")]) for c in STATE.split(", ")])
    spread = plan.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "k")
    found = spread.mapInArrow(lambda b: each(b, sum_up), ", ".join(f"{n} {k}" for n, k in plan.dtypes) + ", " + STATE)
    started = start_states(found).select(*names, "y", "low", "high", "rounds", "base", "base_p")
    return started.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "k").mapInArrow(lambda b: each(b, events), EVENTS)


# ------------------------------------------------------------ writing
@dataclass
class RawWriter(storage.StagedWriter):
    suffix: str = ".raw"

    def write(self, iterator):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), self.attempt()
        name, out, rows, zero, last = f"{attempt}/part-{part:05d}-{attempt[:8]}.raw", None, 0, 0, 0
        for batch in iterator:
            t, x, y, p = (batch.column(c).to_numpy().astype(np.int64) for c in ("t_us", "x", "y", "p"))
            if not len(t):
                continue
            if (np.diff(t) < 0).any() or rows and t[0] < last:
                raise ValueError("events are to be sorted by time within partitions")
            if out is None:
                zero = int(t[0]) >> 24 << 24
                out = self.open(name)
                out.write(f"% evt 3.0\n% first_us {zero}\n".encode())
                words = encode(t - zero, x, y, p)
            else:  # each batch says all anew; the words on the way come from an event that isn't written
                words = encode(np.append(last, t) - (last >> 24 << 24), np.append(0, x), np.append(0, y), np.append(0, p))
                words = words[np.flatnonzero(words >> 12 == ADDR_X)[0] + 1 :]
                words = np.concatenate([np.array([ADDR_Y << 12 | y[0], TIME_LOW << 12 | t[0] & 0xFFF], "<u2"), words])
            out.write(words.tobytes())
            rows, last = rows + len(t), int(t[-1])
        if out is not None:
            out.close()
        return storage.Written([name] if rows else [], rows)


class Evt3(ds.DataSource):
    """The sink ``df.write.format("evt3")`` of events (t_us, x, y, p) sorted by time within partitions: a file for each."""

    @classmethod
    def name(cls):
        return "evt3"

    def schema(self):
        return "t_us long, x int, y int, p int"

    def writer(self, schema, overwrite):
        return RawWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Evt3)
