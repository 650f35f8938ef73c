"""Stupid-backoff scores of documents against their own corpus.

S(w | context) is the relative frequency of the longest n-gram ending in w that
occurs elsewhere, times ``alpha`` for each order given up (Brants et al., 2007).
A document's own n-grams are taken out of all counts first (leave one out), so
that no text vouches for itself.

Documents are read in blocks of about ``block_bytes``, as they lie in their files. Each block's
distinct n-grams with their counts go to count tables partitioned by the n-gram's
hash; each table partition sums the counts and joins the totals
back to the blocks that asked; each block, read again, sums the scores of its documents. What is
shuffled is one row per (block, partition), holding arrays: an n-gram that
makes up a third of the corpus is pre-aggregated to one entry per block. Texts never shuffle, nothing
is pruned or sampled, and nothing gathers at the driver.

As both scans must find the same blocks, ``docs`` is to be read from files (or from
partitions that come out alike each time); a difference is noticed by a digest of each block's n-grams and is an error.

Words are runs of characters other than ASCII white space, lower-cased in A-Z. A
word seen nowhere else counts as seen once.

Defined results: a null or wordless text has n_words 0 and log_score 0; a null
id is kept as null; rows that repeat or share an id are scored one by one, each against all the
others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files, words

class Block:
    """The words of a block of texts, and its distinct n-grams as one sorted array of hashes. The
    empty n-gram, hash 0, stands for the number of all words."""

    def __init__(self, texts: pa.Array, order: int):
        words = [h for some in C.word_hashes(texts) for h in some]
        self.order, self.sizes = order, np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words), dtype=np.int32), self.sizes)

    def grams(self, k: int) -> np.ndarray:
        """Of all texts in order, without those that cross the end of one."""
        return C.gram_hashes(self.words, k)[self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams and how often each occurs. One order after the other, as sorting all at once
        takes several times the memory."""
        keys, counts = [np.zeros(1, np.uint64)], [np.array([len(self.words)], np.int64)]
        for k in range(1, self.order + 1):
            g = self.grams(k)
            g.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
            keys.append(g[first])
            counts.append(np.diff(first, append=len(g)))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if (same := keys[1:] == keys[:-1]).any():  # hashes that meet by chance count together
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        return keys, counts

    def others(self, k: int, keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        """At the n-gram of order ``k`` that ends at each word, its count in other documents; 0 where none ends."""
        at = np.searchsorted(keys, self.grams(k))
        n = total[at]
        doc = self.doc[k - 1 :][self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]]
        some = np.flatnonzero(n > 1)  # what the corpus holds once is the document's own
        out = np.zeros(len(n), np.int64)
        _, inv, own = np.unique((doc[some].astype(np.int64) << 32) | at[some], return_inverse=True, return_counts=True)
        out[some] = n[some] - own[inv]
        every = np.zeros(len(self.words), np.int64)
        every[self.places() >= k - 1] = out
        return every

    def places(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def scores(self, keys: np.ndarray, total: np.ndarray, alpha: float) -> np.ndarray:
        """Sum of log S over each text; ``total``: corpus counts of ``keys``."""
        place, shorter = self.places(), None
        rest = np.maximum(total[0] - self.sizes[self.doc], 1)
        for k in range(1, self.order + 1):  # longer n-grams overrule shorter ones
            n = self.others(k, keys, total)
            up = (np.minimum(place, self.order - 1) - (k - 1)) * np.log(alpha)
            if k == 1:
                log = np.log(np.maximum(n, 1) / rest) + up
            else:
                before = np.concatenate([[1], shorter[:-1]]) if len(n) else shorter  # the context ends one word earlier
                hit = np.flatnonzero(n > 0)
                log[hit] = np.log(n[hit] / np.maximum(before[hit], 1)) + up[hit]
            shorter = n
        return np.bincount(self.doc, log, len(self.sizes))


def pack_keys(keys: np.ndarray, z) -> bytes:
    """Sorted hashes as differences, byte by byte of each, compressed."""
    return z.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(data: bytes, d) -> np.ndarray:
    return np.cumsum(np.frombuffer(d.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def digest(keys: np.ndarray) -> int:
    """Of a block's n-grams, to tell whether another scan has the same."""
    return int(np.bitwise_xor.reduce(words.mix64(keys + np.uint64(len(keys)))).view(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(number, ids, texts) of the blocks of a task's rows; numbers hold for all tasks."""
    from pyspark import TaskContext

    words.take_over("lm")
    nth, held, some = TaskContext.get().partitionId() << 24, 0, []
    join = lambda c: pa.concat_arrays([b.column(c) for b in some])
    for b in batches:
        some.append(b)
        held += b.nbytes
        if held >= block_bytes:
            yield nth, join(0), join(1)
            nth, held, some = nth + 1, 0, []
    if held:
        yield nth, join(0), join(1)


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (natural logarithm)."""
    import zstandard

    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).head()["b"]
    parts = C.shuffle_partitions(spark)
    n = max(1, -(-size // block_bytes), min(parts, size >> 20))
    folder = C.fresh_dir(spark, "lm-totals")
    # bucket of a hash: its top 32 bits, spread over n
    edges = np.array([-(-(b << 32) // n) for b in range(1, n)], np.uint64) << np.uint64(32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for block, _, texts in _blocks(batches, block_bytes):
            keys, counts = Block(texts, order).counts()
            cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            of = digest(keys)
            rows = [(b, block, of, pack_keys(keys[s:e], z), z.compress(counts[s:e].astype("<i8").tobytes())) for b, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "digest", "keys", "counts"])

    def total(table: pa.Table) -> pa.Table:
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(3)
        keys = [unpack_keys(k, d) for k in table.column("keys").to_pylist()]
        sizes = np.cumsum([len(k) for k in keys])
        counts = np.concatenate([np.frombuffer(d.decompress(c), "<i8") for c in table.column("counts").to_pylist()])
        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = np.zeros(len(uniq), np.int64)
        np.add.at(sums, at, counts)
        back = np.split(sums[at], sizes[:-1])
        return pa.table([*(table.column(c) for c in ("bucket", "block", "digest")), pa.array([z.compress(x.astype("<i8").tobytes()) for x in back], pa.binary())], names=["bucket", "block", "digest", "totals"])

    def store(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        d = zstandard.ZstdDecompressor()
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("totals").to_pylist()))
        raw = np.int64(table.column("digest")[0].as_py()).tobytes() + b"".join(d.decompress(t) for _, t in rows)
        files.write(f"{folder}/{block}", zstandard.ZstdCompressor(3).compress(raw))
        return pa.table([pa.array([block], pa.int64())], names=["block"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for block, ids, texts in _blocks(batches, block_bytes):
            k = Block(texts, order)
            of, totals = np.split(np.frombuffer(d.decompress(files.read_all(f"{folder}/{block}")), "<i8"), [1])
            keys, _ = k.counts()
            if len(totals) != len(keys) or of[0] != digest(keys):
                raise ValueError("the second scan found other blocks than the first")
            yield pa.RecordBatch.from_arrays([ids, pa.array(k.sizes), pa.array(k.scores(keys, totals, alpha))], ["doc_id", "n_words", "log_score"])

    asked = docs.mapInArrow(ask, "bucket long, block long, digest long, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(total, "bucket long, block long, digest long, totals binary")
    C.saved(told.groupBy("block").applyInArrow(store, "block long"), "lm-blocks")
    return docs.mapInArrow(settle, "doc_id long, n_words long, log_score double")
