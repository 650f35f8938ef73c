"""Words of whole columns of text as arrays: places, hashes and a table from hashes to numbers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: What each operator keeps in a Python worker from task to task, and how to let it go.
KEPT: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def take_over(name: str) -> None:
    """Called at the start of a task in a Python worker, which Spark uses again for other stages: what
    other operators kept is let go, and free memory goes back to the system."""
    if _OWNER[0] == name:
        return
    _OWNER[0] = name
    for other, clear in KEPT.items():
        if other != name:
            clear()
    gc.collect()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # arrays of 4 MB or more are mapped, and so leave no gaps when they go
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory is reused, but not given back
        pass
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, together: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends) of some whole texts at a time: UTF-8, one text behind the other, null as
    empty, with 8 more bytes at the end that belong to none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + together, "right")) - 1)
        yield np.concatenate([data[ends[at] : ends[to]], np.zeros(8, np.uint8)]), ends[at + 1 : to + 1] - ends[at]
        at = to


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of ``data`` (of ``blocks``), eight bytes at a time."""
    eight = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1)).view("<u8")[:, 0] if len(data) > 7 else np.zeros(0, np.uint64)
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.arange(len(start))
    k = 0
    while len(live):
        left = size[live] - k
        x = eight[start[live] + k]
        part = left < 8
        x = np.where(part, x & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), x)
        h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) + x)
        k += 8
        live = live[left > 8]
    return h


def split(data: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before the end of each text). ``fold`` maps bytes to
    bytes, 32 being what lies between words; no word crosses the end of a text."""
    folded = fold[data]
    folded[-8:] = 0
    inside = np.empty(len(data) - 6, bool)
    inside[0] = inside[-1] = False
    np.not_equal(folded[:-8], 32, out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    inner = ends[:-1]
    inner = inner[(inner > 0) & (inner < len(data) - 8)]
    cut = inner[inside[inner] & inside[inner + 1]]  # a text ends within a run of words
    start = np.flatnonzero(edge & inside[1:])
    stop = np.flatnonzero(edge & inside[:-1])
    if len(cut):
        cut = np.unique(cut)
        start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
    return hashes(folded, start, stop - start), np.searchsorted(start, ends)


class Table:
    """Numbers 0, 1, ... for 64-bit hashes, by open addressing on arrays. Hash 0 counts as 1."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not known."""
        h = np.maximum(h, np.uint64(1))
        slot = (h >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are not known get the next numbers, in order."""
        h = np.maximum(h, np.uint64(1))
        todo = np.arange(len(h))
        slot = (h >> self.shift).astype(np.int64)
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[todo[free]]
            won = free & (self.keys[s] == h[todo])
            self.at[s[won]] = self.n + todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.n += len(h)
