"""Pieces that several training-data operators share: the shared folder, word
splitting, hashing, bitmaps and joins that survive hot keys."""

from __future__ import annotations

import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, shared_root  # noqa: F401
from . import files, words
from .words import mix64

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and every ASCII byte that is no letter or digit becomes a space.
FOLD_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else (c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)
#: The first, and ASCII white space becomes a space; as an array.
FOLD_WORDS = np.frombuffer(bytes(32 if 9 <= c <= 13 else FOLD[c] for c in range(256)), np.uint8)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------ shared storage
_SAVED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    a lost executor costs no recomputation of what lies before. The shuffle files
    of the write go when it is done."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _SAVED[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``saved`` that nothing will read again."""
    for t in tables:
        if t is not None and (path := _SAVED.pop(t, None)):
            files.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches bounded by bytes and by rows. Every operator
    sets the same bounds, so it makes no difference which one did so last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ------------------------------------------------------------ words, hashes
def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def word_hashes(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The hashes of the words of each text, some texts at a time; words are runs of other characters
    than ASCII white space, lower-cased in A-Z."""
    for data, ends in words.blocks(texts):
        h, at = words.split(data, ends, FOLD_WORDS)
        yield np.split(h, at[:-1])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from the hashes of the words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words,
    the whole sequence is the one element; of none, the set is empty."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(width, len(h))))


# ------------------------------------------------------------ bitmaps
PAGE = 32_768  # bits in a bitmap of bitmap_construct_agg


def bitmap_pages(positions: DataFrame) -> DataFrame:
    """(page, bitmap) with the bits of column ``at`` set, by built-in functions."""
    page = F.floor(F.col("at") / PAGE).cast("int")
    return positions.groupBy(page.alias("page")).agg(F.expr(f"bitmap_construct_agg(at % {PAGE})").alias("bitmap"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def with_bit(rows: DataFrame, pages: DataFrame, at: Column, name: str, broadcast: bool = True) -> DataFrame:
    """Adds boolean ``name``: whether bit ``at`` is set in the pages."""
    c_at, c_page, c_map = unused(rows, "_at", "_page", "_map")
    p = pages.select(F.col("page").alias(c_page), F.col("bitmap").alias(c_map))
    out = rows.withColumn(c_at, at).withColumn(c_page, F.floor(F.col(c_at) / PAGE).cast("int")).join(F.broadcast(p) if broadcast else p, c_page, "left")
    inside = F.col(c_at) % PAGE
    byte = F.conv(F.hex(F.substring(c_map, F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, F.pmod(inside, F.lit(8)).cast("int")) == 1, F.lit(False))
    return out.withColumn(name, hit).drop(c_at, c_page, c_map)


def maybe_in(rows: DataFrame, ids: DataFrame, id_col: str, name: str = "_maybe", bits: int = 1 << 26) -> DataFrame:
    """Adds boolean ``name``, false only for rows whose id is certainly not in ``ids``
    (one column): a filter of at most ``bits`` bits (8 MB) is broadcast, so that rows
    that don't matter never shuffle. With very many ids more rows pass, none is lost."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    pages = saved(bitmap_pages(ids.select(spot(F.col(ids.columns[0])).alias("at"))), "id-filter")
    return with_bit(rows, pages, spot(F.col(id_col)), name)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number for each row, and the name of that column: what is decided of a row
    holds for that row alone, though ids be null or repeat. The number is that of
    the place in the files, so ``df`` is to be read from files, as each stage's input is."""
    (row,) = unused(df, "_row")
    return df.withColumn(row, F.monotonically_increasing_id()), row


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in ``ids`` (one column). Rows that the
    filter clears pass straight through; only the others are joined."""
    (maybe,) = unused(docs, "_maybe")
    ids = saved(ids.select(F.col(ids.columns[0]).alias(id_col)), "ids")
    marked = maybe_in(docs, ids, id_col, maybe)
    rest = marked.where(F.col(maybe)).drop(maybe)
    return marked.where(~F.col(maybe)).drop(maybe).unionByName(rest.join(ids, id_col, "left_anti").select(*docs.columns))


# ------------------------------------------------------------ joins
def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, heavy: int, how: str = "inner") -> DataFrame:
    """Join rows to one row per group of them, whatever the size of a group.

    ``count`` holds the group's number of rows. At most ``rows / heavy`` groups
    have ``heavy`` rows or more; the caller picks ``heavy`` in proportion to the
    input (``heavy_bound``), so that those few are broadcast, with a bound that
    doesn't grow, and their rows never shuffle. All others shuffle, in groups
    that are small by definition.
    """
    (flag,) = unused(rows, "_hot")
    hot = F.broadcast(groups.where(F.col(count) >= heavy))
    mark = hot.select(key).withColumn(flag, F.lit(True))
    tagged = rows.join(F.broadcast(mark), key, "left")
    out_hot = tagged.where(F.col(flag)).drop(flag).join(hot, key, "inner")
    out_rest = tagged.where(F.col(flag).isNull()).drop(flag).join(groups.where(F.col(count) < heavy), key, how)
    return out_hot.unionByName(out_rest)


def join_spread(rows: DataFrame, singles: DataFrame, key: str, other: str, heavy: int, counted: DataFrame | None = None) -> DataFrame:
    """Join rows to the few rows that ``singles`` has for their key, which may be large. The
    rows of a key with more than ``heavy`` are dealt by ``other`` to several
    places, and each place gets the key's singles: at most ``rows / heavy`` copies.
    ``counted``: a stored table with the same keys, if ``rows`` is costly to read twice."""
    part, parts = unused(rows, "_part", "_parts")
    hot = F.broadcast((rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / heavy).cast("int").alias(parts)).where(F.col(parts) > 1))
    n = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(hot, key, "left").withColumn(part, F.pmod(F.xxhash64(other), n).cast("int")).drop(parts)
    right = singles.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [key, part]).drop(part)


def heavy_bound(n_rows: int, most_groups: int = 1000, least: int = 200) -> int:
    return max(least, -(-n_rows // most_groups))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)
