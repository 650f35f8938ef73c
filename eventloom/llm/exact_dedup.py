"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every row to ``hashes`` bit positions and keeps the positions that
two or more rows set, as bitmaps of 32,768 bits: a Bloom filter of what is
possibly repeated. Counting is an aggregation with map-side combining, so a
text that holds a third of all rows adds one row per task and position.

Pass 2 tests every row against that filter. A row with a position that no other
row set is certainly unique and passes straight through. Only possibly repeated
rows shuffle, as (id, digest), and are settled exactly by their SHA-256.

The filter has 16 to 32 bits a row up to ``max_bits``. While it has at most ``broadcast_bits``
bits (32 MB), it is broadcast; beyond, rows meet its bitmaps by a shuffled
join. Beyond ``max_bits`` it only passes more rows on to the exact step; the result
is the same.

Equality: texts are equal when identical after lower-casing A-Z only; null
counts as empty. Of equal texts the row with the largest id stays (null ids are
the smallest). Rows that repeat with one id count one by one, and ``kept`` is
true for each row that carries the largest id. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row, written to the shared folder once."""
    text = C.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return C.saved(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256")), "digests")


def _positions(digest: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in range(hashes)]


def repeated_filter(rows: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(page, bitmap): bit positions that at least two rows set."""
    at = rows.select(F.explode(F.array_distinct(F.array(*_positions(F.col("text_sha256"), bits, hashes)))).alias("at"))
    return C.bitmap_pages(at.groupBy("at").agg(F.count("*").alias("n")).where("n > 1"))


def possibly_repeated(rows: DataFrame, filt: DataFrame, bits: int, hashes: int, broadcast: bool) -> DataFrame:
    """The rows with a boolean ``maybe``: all their positions are in the filter."""
    out = rows
    for k, at in enumerate(_positions(F.col("text_sha256"), bits, hashes)):
        out = C.with_bit(out, filt, at, f"_hit{k}", broadcast)
    maybe = reduce(lambda a, b: a & b, (F.col(f"_hit{k}") for k in range(hashes)))
    return out.withColumn("maybe", maybe).drop(*(f"_hit{k}" for k in range(hashes)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = 2, max_bits: int = 1 << 40, broadcast_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    n = rows.count()
    bits = C.PAGE
    while bits < min(max_bits, 16 * n):
        bits *= 2
    filt = C.saved(repeated_filter(rows, bits, hashes), "filter")
    marked = C.saved(possibly_repeated(rows, filt, bits, hashes, bits <= broadcast_bits), "marked")
    once = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.where("maybe").select("doc_id", "text_sha256")
    groups = C.saved(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = C.join_groups(maybe, groups, "text_sha256", "group_size", C.heavy_bound(n))
    again = again.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return once.unionByName(again)
