"""Benchmark decontamination with an FM-index per shard of documents.

Each task gathers documents into shards and indexes a shard's words: a suffix
array gives the Burrows-Wheeler transform, held in a wavelet matrix with rank
directories. All windows of the benchmark are searched backwards together,
occurrences are located by stepping to sampled suffix positions, and the word
spans they cover are merged.

The index leaves out words that no occurrence can contain: words that are in no
benchmark item, and runs of benchmark words shorter than the shortest window.
That is exact, since an occurrence is a run of benchmark words at least that long.

Equal windows of different items are searched once. Benchmark items are collected in slices of
at most ``slice_bytes`` of text, held as arrays of about five bytes a byte; a larger
benchmark means more slices and one scan of the documents for each, so what is
sent to the executors is bounded. Rows of several scans meet again by their place in the
input, which is therefore to be read from files. Documents never shuffle; with several
slices (row, spans, items) do.

Defined results: a null or wordless text has no words and no hits; an item
without words, or with a null id, has no windows; repeated items with one id
count once; a null doc_id is kept as null; documents that repeat give a row each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import words

SPANS = "row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


# ------------------------------------------------------------ index
def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Symbol 0 separates; each separator differs from all
    others, so no comparison runs past one."""
    n = len(symbols)
    cut = symbols == 0
    rank = np.where(cut, np.cumsum(cut) - 1, symbols.astype(np.int64) + cut.sum())
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - k)] = rank[k:] + 1
        key = rank * (max(n, int(rank.max(initial=0))) + 2) + behind
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = step
        if n == 0 or step[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Rank and access over small integers; arguments may be arrays."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before place ``end``."""
        start = np.zeros_like(end)
        for level, ones, zeros in zip(reversed(range(self.depth)), self.ones, self.zeros):
            up = (symbol >> level) & 1 == 1
            s, e = ones[start], ones[end]
            start, end = np.where(up, zeros + s, start - s), np.where(up, zeros + e, end - e)
        return (end - start).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, every: int = 8):
        sa = suffix_array(symbols)
        self.n = len(symbols)
        self.wm = WaveletMatrix(symbols[sa - 1].astype(np.int64))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))]).astype(np.int64)
        # sampled: every k-th place, and each first place after a separator, where no step leads on
        keep = (sa % every == 0) | (symbols[sa - 1] == 0)
        self.sampled = keep
        self.place = np.where(keep, sa, -1)

    def search(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns ``words[start : start + size]``, from their last words to their first."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        live = np.arange(len(start))
        for back in range(1, int(size.max(initial=0)) + 1):
            live = live[(size[live] >= back) & (lo[live] < hi[live])]
            c = words[start[live] + size[live] - back].astype(np.int64)
            known = c + 1 < len(self.before)
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.before[c] + self.wm.rank(c, lo[live])
            hi[live] = self.before[c] + self.wm.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: step back to a sampled suffix and count the steps."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.place[at[done]] + steps
            todo, at = todo[~done], at[~done]
            c = self.wm.access(at)
            at = self.before[c] + self.wm.rank(c, at)
            steps += 1
        return out


# ------------------------------------------------------------ benchmark
class Windows:
    """The distinct windows of a slice of the benchmark over its own vocabulary, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocab: dict[bytes, int] = {}
        names = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items))}
        self.items = list(names)
        every, start, size, owner, at = [np.zeros(0, np.int32)], [], [], [], 0
        for i, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.translate(C.FOLD_ALNUM).split()], np.int32)
            n = max(1, len(ids) - width + 1) if len(ids) else 0
            every.append(ids)
            start.append(at + np.arange(n))
            size.append(np.full(n, min(width, len(ids)), np.int16))
            owner.append(np.full(n, names[i], np.int32))
            at += len(ids)
        self.words = np.concatenate(every)
        start, size, owner = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((start, np.int64), (size, np.int16), (owner, np.int32)))
        key = size.astype(np.uint64)
        for k in range(width):
            w = self.words[np.minimum(start + k, max(0, at - 1))].astype(np.uint64) if at else key
            key = C.mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.where(k < size, w, 0).astype(np.uint64))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.sizes = start[first], size[first].astype(np.int64)
        # the items of window k: owner[at[k] : at[k + 1]]
        pairs = np.unique(np.stack([which.astype(np.int64), owner.astype(np.int64)]), axis=1) if at else np.zeros((2, 0), np.int64)
        self.owner = pairs[1].astype(np.int32)
        self.at = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.least = int(self.sizes.min(initial=width))

    def items_of(self, docs: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, str]]:
        """Distinct (document, item) of pairs of document and window."""
        pairs = np.unique(np.stack([docs, windows]), axis=1)
        n = self.at[pairs[1] + 1] - self.at[pairs[1]]
        place = np.repeat(self.at[pairs[1]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for d, k in np.unique(np.stack([np.repeat(pairs[0], n), self.owner[place]]), axis=1).T.tolist():
            yield d, self.items[k]


def scan_shard(texts: list[bytes | None], w: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged spans of hit words, items) of each text of a shard."""
    get, ids = w.vocab.get, []
    for t in texts:
        words = t.translate(C.FOLD_ALNUM).split() if t else []
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    sizes = np.array([len(i) for i in ids], np.int64)
    # a wall between documents, so that no run crosses one
    every = np.concatenate([x for i in ids for x in (i, np.zeros(1, np.int32))]) if ids else np.zeros(0, np.int32)
    doc_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.concatenate([[0], (every > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= w.least
    first, last = first[long], last[long]
    empty = [(int(n), [], []) for n in sizes]
    if not len(first) or not len(w.start):
        return empty
    size = last - first + 1  # with the separator behind each run
    start = np.cumsum(size) - size
    origin = np.repeat(first - start, size) + np.arange(size.sum())  # place in the index to place in the shard
    symbols = every[np.minimum(origin, len(every) - 1)].copy()
    symbols[start + size - 1] = 0
    index = FMIndex(symbols)
    lo, hi = index.search(w.words, w.start, w.sizes)
    n = np.maximum(hi - lo, 0)
    if not n.sum():
        return empty
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    at = origin[index.locate(rows)]
    cover = np.zeros(len(every) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + w.sizes[which], -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # adjacent documents have a wall between them, which nothing covers
    doc = np.searchsorted(doc_at, a, "right") - 1
    for d, s, e in zip(doc.tolist(), (a - doc_at[doc]).tolist(), (b - doc_at[doc]).tolist()):
        empty[d][1].append((s, e))
    for d, item in w.items_of(np.searchsorted(doc_at, at, "right") - 1, which):
        empty[d][2].append(item)
    return empty


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).head()["b"]
    n = max(1, -(-2 * size // slice_bytes))  # half full, as items are dealt by hash
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"].encode()) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 4 << 20, slice_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans (merged, in words) and items."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for items in _slices(benchmark, item_col, item_text_col, slice_bytes):
        w = docs.sparkSession.sparkContext.broadcast(Windows(items, width))

        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            words.take_over("decontaminate")
            rows: list = []
            ids: list = []
            texts: list = []
            held = 0

            def close() -> pa.RecordBatch:
                found = scan_shard(texts, w.value)
                spans = [[{"start": s, "stop": e} for s, e in f[1]] for f in found]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, kind), pa.array([f[2] for f in found], pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])

            for b in batches:
                for r, i, t in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), C.utf8(b, "text")):
                    rows.append(r)
                    ids.append(i)
                    texts.append(t)
                    held += len(t or b"")
                    if held >= shard_bytes:
                        yield close()
                        rows, ids, texts, held = [], [], [], 0
            if ids:
                yield close()

        parts.append(docs.mapInArrow(run, SPANS))
    every = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            every = every.unionByName(p)
        # as many rows for each as there are slices
        both = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
        every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *both)
        every = every.withColumn("spans", merged_spans("spans")).withColumn("items", F.array_distinct("items"))
    return every.drop("row")


def merged_spans(col: str):
    """Union of overlapping or touching spans, by DataFrame functions."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    return F.expr(
        f"aggregate(array_sort({col}), cast(array() as {kind}), (acc, s) -> "
        "if(size(acc) > 0 and element_at(acc, -1).stop >= s.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))), "
        "concat(acc, array(s))))"
    )
