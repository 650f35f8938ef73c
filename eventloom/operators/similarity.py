"""Descriptors, all-pairs similarity, ranking and match features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Per-channel mean and deviation customary for RGB inputs.
RGB_MEAN = (0.485, 0.456, 0.406)
RGB_STD = (0.229, 0.224, 0.225)


def normalise_rgb(v: Column, channel: Column) -> Column:
    """0..255 of channel 0, 1, 2 to normalised input."""
    mean, std = (F.array(*[F.lit(x) for x in xs]) for xs in (RGB_MEAN, RGB_STD))
    return (v / 255 - F.element_at(mean, channel + 1)) / F.element_at(std, channel + 1)


def pooled_descriptor(pixels: DataFrame, height: int, width: int, cell: int = 8, empty: float = 0.0) -> DataFrame:
    """(seq, bin_id, vec): averages of cell x cell blocks (floor edges) of sparse
    pixels (…, y, x, v), flattened and scaled to length 1. ``empty``: what untouched pixels hold."""
    gh, gw = height // cell, width // cell
    inside = pixels.where((F.col("y") < gh * cell) & (F.col("x") < gw * cell))
    at = (F.floor(F.col("y") / cell) * gw + F.floor(F.col("x") / cell)).cast("int")
    block = inside.groupBy("seq", "bin_id", at.alias("k")).agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    mean = (F.col("s") + (cell * cell - F.col("c")) * empty) / (cell * cell)
    m = block.groupBy("seq", "bin_id").agg(F.map_from_entries(F.collect_list(F.struct("k", mean.alias("v")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(gh * gw - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(float(empty))))
    return m.select("seq", "bin_id", unit(dense).alias("vec"))


def unit(vec: Column) -> Column:
    """A vector scaled to length 1; one shorter than 1e-8 stays."""
    n = norm(vec)
    return F.transform(vec, lambda x: x / F.when(n < 1e-8, 1.0).otherwise(n))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def patch_of(y: Column, x: Column, height: int, width: int, rows: int, cols: int) -> Column:
    """Number of the grid patch of a pixel; null in the remainder."""
    ph, pw = height // rows, width // cols
    return F.when((y < ph * rows) & (x < pw * cols), F.floor(y / ph) * cols + F.floor(x / pw)).cast("int")


def unit_range(pixel: Column) -> Column:
    """0..255 scaled to -1..1."""
    return pixel / 127.5 - 1


def _blocks(df: DataFrame, on: list[str], name: str, block: int) -> DataFrame:
    """(on, {name}i, {name}v): numbers and vectors of ``block`` rows as one."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("idx").to_numpy().astype(np.int64)
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        one = table.slice(0, 1)
        return pa.table([*(one.column(c) for c in on), pa.array([ids.tobytes()]), pa.array([vec.tobytes()])], names=[*on, f"{name}i", f"{name}v"])

    kinds = dict(df.dtypes)
    cut = df.select(*on, "idx", "vec", F.floor(F.col("idx") / block).alias("_b"))
    return cut.groupBy(*on, "_b").applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in on), f"{name}i binary", f"{name}v binary"]))


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of a with each of b; higher is better: l2 (minus the squared distance), cosine or sad."""
    if metric == "cosine":
        return (a @ b.T) / (np.sqrt((a * a).sum(1)) + 1e-8)[:, None] / (np.sqrt((b * b).sum(1)) + 1e-8)
    far = np.square if metric == "l2" else np.abs
    return -np.stack([far(b - x).sum(1) for x in a])


def score_runs(queries: DataFrame, refs: DataFrame, metrics: tuple[str, ...], block: int = 512) -> DataFrame:
    """(metric, run, patch, q, r, s) for all pairs of one run and patch (columns that both sides have), in each metric: blocks of vectors
    meet, and each pair of blocks is scored as arrays. Every pair is a row of the result, whatever comes of it."""
    on = [c for c in ("run", "patch") if c in queries.columns]
    q, r = _blocks(queries, on, "q", block), _blocks(refs, on, "r", block)
    pairs = q.join(r, on) if on else q.crossJoin(r)
    out = ["metric string", *(f"{c} {dict(queries.dtypes)[c]}" for c in on), "q int", "r int", "s double"]
    names = [f.split()[0] for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                qi, qv, ri, rv = (b.column(c)[k].as_buffer() for c in ("qi", "qv", "ri", "rv"))
                qi, ri = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                qv, rv = np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(rv).reshape(len(ri), -1)
                n = len(qi) * len(ri)
                own = [pa.array([b.column(c)[k].as_py()] * n, b.schema.field(c).type) for c in on]
                for m in metrics:
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [m]).cast(pa.string()), *own, pa.array(np.repeat(qi, len(ri)).astype(np.int32)), pa.array(np.tile(ri, len(qi)).astype(np.int32)), pa.array(_scores(qv, rv, m).ravel())], names)

    return pairs.mapInArrow(run, ", ".join(out))


def all_pairs(queries: DataFrame, refs: DataFrame, metric: str = "l2") -> DataFrame:
    """(run, patch, q, r, s) for all pairs of one run and patch in one metric."""
    return score_runs(queries, refs, (metric,)).drop("metric")


def block_top1(queries: DataFrame, refs: DataFrame, metric: str = "l2", block: int = 2048) -> DataFrame:
    """(q, r, s): best reference per query, the smallest r on ties.

    Vectors are packed into blocks, block pairs are multiplied as matrices, and each gives
    one row per query, so that Q x R scores never become rows. Memory: two blocks.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids = np.asarray(b.column("idx").to_numpy(zero_copy_only=False), np.int64)
                    vec = np.asarray(b.column("vec").flatten().to_numpy(zero_copy_only=False), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([vec.tobytes()])], [f"{name}i", f"{name}v"])

        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
        return df.select("idx", "vec").mapInArrow(run, f"{name}i binary, {name}v binary")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, ri, rv in zip(*(b.column(c).to_pylist() for c in ("qi", "qv", "ri", "rv"))):
                qi, ri = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                qv, rv = np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(rv).reshape(len(ri), -1)
                o = np.argsort(ri, kind="stable")
                ri, rv = ri[o], rv[o]
                if metric == "sad":
                    s = np.stack([-np.abs(rv - x).sum(axis=1) for x in qv])
                elif metric == "cosine":
                    s = (qv / (np.linalg.norm(qv, axis=1, keepdims=True) + 1e-8)) @ (rv / (np.linalg.norm(rv, axis=1, keepdims=True) + 1e-8)).T
                else:
                    s = 2 * qv @ rv.T - (qv * qv).sum(1)[:, None] - (rv * rv).sum(1)[None]
                k = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(ri[k]), pa.array(s[np.arange(len(k)), k])], ["q", "r", "s"])

    pairs = packed(queries, "q").crossJoin(packed(refs, "r"))
    got = pairs.mapInArrow(best, "q long, r long, s double")
    return top1(got)


def top1(sim: DataFrame, *keys: str) -> DataFrame:
    """Best r per (keys, q), the smallest r on ties; partial maxima before the shuffle."""
    m = F.max(F.struct("s", (-F.col("r")).alias("nr"))).alias("m")
    return sim.groupBy(*keys, "q").agg(m).select(*keys, "q", (-F.col("m.nr")).alias("r"), F.col("m.s").alias("s"))


def ranked(sim: DataFrame, *keys: str) -> DataFrame:
    return sim.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "q").orderBy(F.col("s").desc(), "r")))


def recall_at(sim: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(k, recall): share of queries with positives that have one among their best k."""
    top = ranked(sim).where(F.col("rank") <= max(ks)).join(positives.withColumn("_hit", F.lit(True)), ["q", "r"], "left_semi").groupBy("q").agg(F.min("rank").alias("first"))
    have = positives.select("q").distinct().join(sim.select("q").distinct(), "q", "left_semi").join(top, "q", "left")
    one = have.agg(*[F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")).alias(f"_{k}") for k in ks])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("recall")) for k in ks])))


def label_recall_at(top: DataFrame, queries: DataFrame, refs: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """The same where references of a query's label are its positives, from at least the best max(ks) references of each query (q, r, s): no
    table of pairs is made."""
    from .metrics import label_hits

    h = label_hits(ranked(top).where(F.col("rank") <= max(ks)), queries, refs)
    one = h.where("has_gt").groupBy("q").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    mean = one.agg(*[F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")).alias(f"_{k}") for k in ks])
    return mean.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("recall")) for k in ks])))


def min_max(df: DataFrame, value: str, *keys: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scaled to [low, high] within keys; a constant becomes ``low``."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if keys else df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    v = low + (F.col(value) - F.col("_lo")) * (high - low) / (F.col("_hi") - F.col("_lo"))
    return j.withColumn(value, F.when(F.col("_lo") == F.col("_hi"), F.lit(low)).otherwise(v)).drop("_lo", "_hi")


def entropy(pixels: DataFrame, *keys: str) -> DataFrame:
    """Shannon entropy in bits of the 256-bin histogram of 0..256 of a frame or patch."""
    h = pixels.where((F.col("v") >= 0) & (F.col("v") <= 256)).groupBy(*keys, F.least(F.floor("v"), F.lit(255)).alias("b")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*keys))
    return h.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def match_features(sim: DataFrame, *keys: str) -> DataFrame:
    """Per query: z-score and ratio of the best match, its lead over the second,
    sum of absolutes, spread, and positives over negatives (over 1 if there are none)."""
    k = [*keys, "q"]
    best = F.max("s")
    g = sim.groupBy(*k).agg(
        best.alias("corr_max"), F.avg("s").alias("corr_mean"), F.stddev_pop("s").alias("corr_std"), F.sum(F.abs("s")).alias("abs_sum"),
        F.sum((F.col("s") > 0).cast("long")).alias("_pos"), F.sum((F.col("s") < 0).cast("long")).alias("_neg"),
    )
    two = sim.withColumn("_r", F.row_number().over(W.partitionBy(*k).orderBy(F.col("s").desc()))).where("_r = 2").select(*k, F.col("s").alias("_second"))
    j = g.join(two, k, "left")
    z = (F.col("corr_max") - F.col("corr_mean")) / F.when(F.col("corr_std") > 0, F.col("corr_std")).otherwise(1.0)
    ratio = F.when(F.col("corr_mean") > 0, F.col("corr_max") / F.col("corr_mean")).otherwise(0.0)
    return j.select(*k, "corr_max", "corr_mean", "corr_std", z.alias("z_score"), ratio.alias("peak_to_mean"), (F.col("corr_max") - F.col("_second")).alias("best_second_diff"), "abs_sum", (F.col("_pos") / F.greatest(F.col("_neg"), F.lit(1))).alias("polarity_ratio"))


def path_overlap(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(points, overlap_pct): share of a's points with a point of b nearer than ``radius``."""
    from .joins import radius_join

    hit = radius_join(a, b, radius, inclusive=False).select("q").distinct().withColumn("_h", F.lit(1))
    return a.join(hit, "q", "left").agg(F.count("*").alias("points"), (100 * F.count("_h") / F.count("*")).alias("overlap_pct"))
