"""A Merkle manifest of a table: one tree of digests per source, one tree over the sources' roots,
and a proof for each row, by built-in functions only.

*Leaves.* H of a row's fields, each as ``-`` if null, else its UTF-8 length, ``:`` and its value; H is the
lower-case hex SHA-256, and digests enter it as hex text.

*Trees.* Rows are sorted by (source, id, leaf) into ranges and written, each with its place; the rank
of a row within its source is its place in its range plus the rows of the source in the ranges before. While a level
of a source has several nodes, every ``fanout`` consecutive ones become one of the next level,
which is written sorted by (source, number) beside it: the store is a folder per level, and a level is one
pass over the one below. A source holding a third of all rows is spread over many ranges like any other.

*Proofs.* From the root down, a node's way up is its siblings on either side followed by its parent's way: each
level is joined to the one above by coordinate (source, number of the parent), sorted runs against sorted
runs. A run has at most ``fanout`` nodes, a way as many entries as the trees have levels.

Ids ascend with nulls first; rows of one id go by leaf, so that rows that repeat wholly are
interchangeable. A null source is a source of its own, the first; sources go by their UTF-8 bytes. Empty
texts are leaves like others. Other columns are ignored, whatever their names; an empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Offsets of ranges, one row a range and a source, are broadcast up to this number.
MOST_OFFSETS = 100_000
#: Rows of digests in a range.
RANGE_ROWS = 1 << 19


@dataclass
class Store:
    """Levels of nodes (tree, at, digest, size), from the leaves up; ``size`` is the number of nodes of the tree on that level."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        out = [x.where("size = 1").select("tree", "digest") for x in self.levels]
        for x in out[1:]:
            out[0] = out[0].unionByName(x)
        return out[0]

    def discard(self) -> None:
        C.discard(*self.levels)


def encoded(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _ranges(spark: SparkSession, rows: int) -> int:
    return max(1, min(C.shuffle_partitions(spark), -(-rows // 1000)), -(-rows // RANGE_ROWS))


def ranked(rows: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """``rows`` (with column ``tree``) sorted into ranges by tree and ``order``, with ``at``, the 0-based rank within
    the tree, and ``size``, the number of the tree's rows."""
    keys = ["tree", *order]
    place = F.monotonically_increasing_id()
    stored = C.saved(rows.repartitionByRange(_ranges(rows.sparkSession, n), *keys).sortWithinPartitions(*keys).withColumn("place", place).withColumn("part", F.shiftright("place", 33)), name)
    parts = stored.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    whole = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = C.saved(parts.select("tree", "part", (before - F.col("first")).alias("offset"), F.sum("rows").over(whole).alias("size")), name + "-offsets")
    few = F.broadcast(offsets) if offsets.count() <= MOST_OFFSETS else offsets
    return stored.join(few, ["tree", "part"]).withColumn("at", F.col("place") + F.col("offset")).drop("place", "part", "offset")


def _runs(level: DataFrame, fanout: int, n: int, *more: str) -> DataFrame:
    """(tree, at of the parent, nodes in order): the runs of a level, sorted by coordinate."""
    up = level.select("tree", F.floor(F.col("at") / fanout).cast("long").alias("up"), "size", F.struct("at", "digest", *more).alias("node")).where("size > 1")
    runs = up.repartitionByRange(_ranges(level.sparkSession, n), "tree", "up").groupBy("tree", "up", "size").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return runs.withColumnRenamed("up", "at")


def grow(leaves: DataFrame, n: int, fanout: int, name: str) -> Store:
    """The store of the trees over ``leaves`` (tree, at, digest, size), themselves its first level."""
    levels, most = [leaves], leaves.agg(F.max("size")).head()[0] or 0
    while most > 1:
        runs = _runs(levels[-1], fanout, n)
        digest = F.sha2(joined(F.col("nodes.digest")).cast("binary"), 256)
        nodes = runs.select("tree", "at", digest.alias("digest"), F.ceil(F.col("size") / fanout).cast("long").alias("size"))
        levels.append(C.saved(nodes, f"{name}-level-{len(levels)}"))
        n, most = n // fanout + 1, -(-most // fanout)
    return Store(levels)


def ways(store: Store, top: DataFrame, n: int, fanout: int, *more: str) -> DataFrame:
    """(tree, digest, way, ...) of the leaves. A way is an array of (left, right), the joined siblings on each side,
    from the node up; ``top`` (tree, way, ...) continues it from each tree's root. ``more``: columns of the leaves to keep."""
    above = None
    for k in reversed(range(len(store.levels))):
        level, own = store.levels[k], more if k == 0 else ()
        rest = [c for c in top.columns if c not in ("tree", "way")]
        out = level.where("size = 1").select("tree", "at", "digest", *own).join(top, "tree")
        if above is not None:
            met = _runs(level, fanout, max(1, n // fanout**k), *own).drop("size").join(above, ["tree", "at"])
            met = met.select("tree", F.col("nodes.digest").alias("digests"), "way", *rest, F.posexplode("nodes").alias("k", "node"))
            left = joined(F.slice("digests", F.lit(1), F.col("k")))
            right = joined(F.slice("digests", F.col("k") + 2, F.lit(fanout)))
            way = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "way")
            out = out.unionByName(met.select("tree", "node.at", "node.digest", *[f"node.{c}" for c in own], way.alias("way"), *rest))
        if k:
            above = C.saved(out.drop("digest"), "ways")
        else:
            return out


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", altered: dict[str, Column] | None = None, fanout: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot`` and ``root``, ``way`` (from the leaf up, the siblings left and
    right on each level, subtrees first), ``present`` (the leaf recomputed with ``altered``, columns that stand
    for fields as they are found now) and ``folded_root`` (from ``present`` up the way)."""
    spark, n = docs.sparkSession, docs.count()
    now = [(altered or {}).get(f, F.col(f)) for f in fields]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf(*map(F.col, fields)).alias("digest"),
        leaf(*now).alias("present"),
    )
    lower = grow(ranked(rows.select("tree", "id", "digest", F.nullif("present", "digest").alias("present")), ["id", "digest"], n, "leaves"), n, fanout, "tree")
    subroots = C.saved(lower.roots, "subroots")
    m = subroots.count()
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    upper = grow(ranked(names, ["source"], m, "sources"), m, fanout, "top")
    root = upper.roots.select(F.lit("").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("way"), F.col("digest").alias("root"))
    top = ways(upper, root, m, fanout, "source")
    top = C.saved(top.select(F.col("source").alias("tree"), "way", F.col("digest").alias("subroot"), "root"), "top-ways")
    found = ways(lower, top, n, fanout, "id", "present")
    present = F.coalesce("present", "digest")
    folded = F.aggregate("way", present, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "way", present.alias("present"), folded.alias("folded_root"))


def proof_digest(way: Column) -> Column:
    """H of the siblings of a way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
