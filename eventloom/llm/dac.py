"""Directly addressable codes for token ids.

Each id is split into chunks of 8 bits, lowest first. Level k holds the k-th
chunk of every id that has one, in order, with a bitmap that says whether the id
continues on the next level, and a rank directory that counts the set bits
before each block of 512. Where an id continues is then a rank away, so any
token is read in at most as many steps as it has chunks, without decoding a
block of others.

A file: magic, length of the header, header (JSON: counts and the place of each
section), sections. Ids of documents and the tokens before each document are
sections of their own.

Defined results: a null text counts as empty (only the end id); a null id sorts
first; repeated rows are written one by one, rows of one id in any order; other columns are ignored; an empty
table gives no file and no row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import encoder, files

MAGIC = b"EVLDAC1\n"
BLOCK = 512  # bits a rank entry covers
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of {chunks, bitmap, ranks} of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per = _POP[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        levels.append({"chunks": (rest & 255).astype(np.uint8), "bitmap": bits, "ranks": np.concatenate([[0], np.cumsum(per)]).astype("<u8")})
        if not more.any():
            return levels
        rest = rest[more] >> 8


def write(out, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    known = np.packbits([d is not None for d in doc_ids], bitorder="little")
    parts = {"doc_ids": np.asarray([d or 0 for d in doc_ids], "<i8"), "known": known, "starts": starts}
    levels = encode(ids)
    for k, lv in enumerate(levels):
        parts |= {f"{name}{k}": a for name, a in lv.items()}
    place, at = {}, 0
    for name, a in parts.items():
        place[name] = [at, a.nbytes]
        at += a.nbytes
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": len(levels), "at": place}).encode()
    out.write(MAGIC + struct.pack("<Q", len(head)) + head)
    for a in parts.values():
        out.write(a.tobytes())


class Reader:
    """Random access to the tokens of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (n,) = struct.unpack_from("<Q", data, 8)
        h = json.loads(data[16 : 16 + n])
        get = lambda name, kind: np.frombuffer(data, kind, h["at"][name][1] // np.dtype(kind).itemsize, 16 + n + h["at"][name][0])
        known = np.unpackbits(get("known", "u1"), bitorder="little")
        self.doc_ids = [int(d) if k else None for d, k in zip(get("doc_ids", "<i8"), known)]
        self.starts, self.n_tokens = get("starts", "<u8").astype(np.int64), h["tokens"]
        self.levels = [(get(f"chunks{k}", "u1"), get(f"bitmap{k}", "u1"), get(f"ranks{k}", "<u8")) for k in range(h["levels"])]

    def _rank(self, k: int, i: int) -> int:
        """Set bits before bit ``i`` of level ``k``."""
        _, bits, ranks = self.levels[k]
        b = i // BLOCK
        n, at = int(ranks[b]), b * (BLOCK // 8)
        n += int(_POP[bits[at : i // 8]].sum())
        return n + (int(_POP[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def token(self, i: int) -> int:
        """The id at place ``i``: one rank for each further chunk."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = k = 0
        while True:
            chunks, bits, _ = self.levels[k]
            value |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, k = self._rank(k, i), k + 1

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1; what continues lies together on each level."""
        out, where = np.zeros(b - a, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].view(bool)
            if not more.any():
                break
            where = np.flatnonzero(more) if where is None else where[more]
            a = self._rank(k, a)
            b = a + len(where)
        return out

    def document(self, d: int) -> np.ndarray:
        return self.tokens(int(self.starts[d]), int(self.starts[d + 1]))


def write_archive(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and write the documents in the order of their ids.

    Returns the list of files: (part, nth, path, n_docs, n_tokens, start), start
    being the tokens of all files before. A file is closed once it holds
    ``file_tokens``. Files are summed within each partition, and partitions once more.
    """
    spark = docs.sparkSession
    tokenizer, folder = tokenizer or encoder.default_tokenizer(), C.fresh_dir(spark, "dac")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder.encoder(tokenizer), TaskContext.get().partitionId()
        docs, lens, parts, held, rows = [], [], [], 0, []

        def close() -> None:
            with files.writing(folder, ".dac") as (out, path):
                write(out, docs, np.concatenate(lens), np.concatenate(parts))
            rows.append((part, len(rows), path, len(docs), held))

        for b in batches:
            named, at = b.column(0).to_pylist(), 0
            for ids, n in enc.encode(b.column(1)):
                ids, n = encoder.with_end(ids, n, end_id)
                docs += named[at : at + len(n)]
                at += len(n)
                lens.append(n)
                parts.append(ids)
                held += len(ids)
                if held >= file_tokens:
                    close()
                    docs, lens, parts, held = [], [], [], 0
        if docs:
            close()
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "nth", "path", "n_docs", "n_tokens"])

    C.small_batches(spark)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # many rows of one id are split by where they were read
    ordered = ordered.withColumn("from", F.spark_partition_id())
    ordered = ordered.repartitionByRange(C.shuffle_partitions(spark), "doc_id", "from").sortWithinPartitions("doc_id", "from").drop("from")
    listed = C.saved(ordered.mapInArrow(run, "part int, nth int, path string, n_docs long, n_tokens long"), "dac-files")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    parts = listed.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("base"))
    return listed.withColumn("start", before(W.partitionBy("part").orderBy("nth"))).join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_archive(listed: DataFrame) -> DataFrame:
    """Per document of the listed files: its start among all tokens, its length
    and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                r = Reader(files.read_all(path))
                crc = [zlib.crc32(r.document(d).astype("<u4")) for d in range(len(r.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64()), pa.array(r.starts[:-1] + start), pa.array(np.diff(r.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = listed.sparkSession
    spread = listed.select("path", "start").repartition(C.shuffle_partitions(spark), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
