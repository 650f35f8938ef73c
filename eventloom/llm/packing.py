"""Best-fit packing of token sequences.

Documents are tokenized and cut into pieces of at most ``max_len`` tokens; only
longer documents are cut, and only their first piece may be shorter. The pieces
are then packed by bulk-synchronous best fit:

1. *Range sort.* The pieces are sorted by (length descending, id, piece) over
   all machines; each gets its rank from its partition's offset. Any number of
   equal lengths may lie in any number of partitions, so no length is hot.
2. *Supersteps.* From the longest length down, all pieces of a length are
   matched at once with the sorted gaps: each takes its successor, the smallest
   gap that holds it. Conflicts, many pieces wanting one gap, are resolved by
   rank: the r-th piece gets the r-th place. Then the gaps are updated, and the
   next length follows.
3. *Assignment.* Each piece finds the sweep segment of its rank by a binary
   search, in a narrow pass over the sorted table.

Sorted gaps are kept run-length coded. Sequences with the same gap are
interchangeable, so a run is (gap, first sequence, how many), and one match of a
run stands for all its sequences. There are at most ``max_len`` lengths and as
many gaps, so the supersteps work on a table bounded by ``max_len`` and not by
the documents; nothing of a document or piece reaches the driver.

Defined results: a null text counts as empty (one piece holding the end id); a
null id is kept as null; repeated rows are pieces of their own; columns other
than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of ``n`` tokens."""
    pieces = -(-n // max_len)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * max_len
    start = np.where(piece > 0, first[doc] + (piece - 1) * max_len, 0)
    return doc, piece, start, np.where(piece > 0, max_len, first[doc])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder.encoder(tokenizer)
        for b in batches:
            at = 0
            for ids, n in enc.encode(b.column(1)):
                ids, n = encoder.with_end(ids, n, end_id)
                doc, piece, start, length = cut(n, max_len)
                crc = encoder.crcs(ids, (np.cumsum(n) - n)[doc] + start, length)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(n)

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


class Gaps:
    """Open sequences sorted by gap, as runs [first sequence, how many]."""

    def __init__(self, max_len: int):
        self.max_len, self.runs, self.sorted, self.opened = max_len, {}, [], 0

    def put(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.runs:
                bisect.insort(self.sorted, gap)
                self.runs[gap] = []
            last = self.runs[gap]
            if last and last[-1][0] + last[-1][1] == first:
                last[-1][1] += n
            else:
                last.append([first, n])

    def successor(self, length: int) -> int | None:
        at = bisect.bisect_left(self.sorted, length)
        return self.sorted[at] if at < len(self.sorted) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        runs = self.runs[gap]
        first, n = runs[0]
        k = min(n, most)
        if k == n:
            runs.pop(0)
        else:
            runs[0] = [first + k, n - k]
        if not runs:
            del self.runs[gap]
            self.sorted.remove(gap)
        return first, k


def sweep(counts: dict[int, int], max_len: int) -> list[tuple[int, int, int, int]]:
    """Best fit by decreasing length over runs of equal pieces.

    Returns segments (first rank, first sequence, pieces per sequence, first
    offset) in the order of rank, where ranks count the pieces from the longest.
    """
    gaps, rank, out = Gaps(max_len), 0, []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = gaps.successor(length)
            if gap is None:
                gap, n = max_len, -(-left // (max_len // length))
                first, gaps.opened = gaps.opened, gaps.opened + n
            else:
                first, n = gaps.take(gap, -(-left // (gap // length)))
            deep = gap // length
            full, rest = min(n, left // deep), 0
            if full:
                out.append((rank, first, deep, max_len - gap))
                gaps.put(gap - deep * length, first, full)
            if full < n:  # the last sequence takes what is left of this length
                rest = left - full * deep
                out.append((rank + full * deep, first + full, rest, max_len - gap))
                gaps.put(gap - rest * length, first + full, 1)
            rank, left = rank + full * deep + rest, left - full * deep - rest
    return out


def pack(pieces: DataFrame, max_len: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces of (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    n = C.shuffle_partitions(spark)
    rank = F.monotonically_increasing_id()
    pieces = C.saved(pieces, "pieces")
    ranked = C.saved(
        pieces.repartitionByRange(n, F.col("length").desc(), "doc_id", "piece").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece").withColumn("_at", rank),
        "ranked",
    )
    # both are bounded: by max_len, and by the number of partitions
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = ranked.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect()
    size = np.zeros(max([r["part"] for r in sizes], default=0) + 1, np.int64)
    for r in sizes:
        size[r["part"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    seg = np.asarray(sweep(counts, max_len), np.int64).reshape(-1, 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("_at").to_numpy()
            r = before[at >> 33] + (at & ((1 << 33) - 1))
            s = seg[np.searchsorted(seg[:, 0], r, "right") - 1]
            k = r - s[:, 0]
            seq, off = s[:, 1] + k // s[:, 2], s[:, 3] + k % s[:, 2] * b.column("length").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the documents into as few sequences of ``max_len`` tokens as best
    fit by decreasing length finds. One row per piece."""
    return pack(token_pieces(docs, tokenizer or encoder.default_tokenizer(), end_id, max_len, id_col, text_col), max_len)
