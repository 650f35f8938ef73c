"""Windows of event streams: by time, by count, by motion, by gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds, ranks


def time_bins(bounds: DataFrame, delta: float) -> DataFrame:
    """Fixed bins (seq, bin_id, t0, t1) from (seq, t_first, t_last).

    Starts run from t_first in steps of ``delta`` while below t_last - delta, so the
    trailing partial bin, and a last bin that ends exactly at t_last, is dropped.
    """
    n = F.ceil((F.col("t_last") - delta - F.col("t_first")) / delta).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    k = F.col("bin_id")
    return bounds.select("seq", "t_first", F.explode(ids).alias("bin_id")).select("seq", "bin_id", (F.col("t_first") + k * delta).alias("t0"), (F.col("t_first") + (k + 1) * delta).alias("t1"))


def assign_time_bins(events: DataFrame, bounds: DataFrame, delta: float) -> DataFrame:
    """Each event with the fixed bins whose closed interval holds it: an event on
    a shared edge is in both. No range join: the bin is computed, its neighbours are
    tried, and the stored edges decide."""
    t, a = F.col("t"), F.col("t_first")
    n = F.ceil((F.col("t_last") - delta - a) / delta)
    k = F.floor((t - a) / delta)
    inside = F.filter(F.array(k - 1, k, k + 1), lambda c: (c >= 0) & (c < n) & (t >= a + c * delta) & (t <= a + (c + 1) * delta))
    return events.join(bounds, "seq").withColumn("bin_id", F.explode(inside)).withColumn("bin_id", F.col("bin_id").cast("int")).drop("t_first", "t_last")


def interval_join(events: DataFrame, bins: DataFrame, width: float) -> DataFrame:
    """Closed-interval join of events with any bins (seq, bin_id, t0, t1), by equal
    buckets of time and an exact filter. ``width`` should be near a bin's length."""
    b = bins.withColumn("_k", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    e = events.withColumn("_k", F.floor(F.col("t") / width))
    return e.join(b, ["seq", "_k"]).where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))).drop("_k")


def count_bins(events: DataFrame, size: int, bucket: float) -> DataFrame:
    """bin_id of every ``size`` consecutive events of a sequence; the last partial
    bin is kept."""
    ranked = ranks.global_rank(events, "seq", ["t", "event_id"], bucket, "_rank")
    return ranked.withColumn("bin_id", F.floor(F.col("_rank") / size).cast("int")).drop("_rank")


def count_bin_table(binned: DataFrame, mid: bool = True) -> DataFrame:
    """(seq, bin_id, t0, t1, t_gt, n): ground truth at the middle or the start."""
    out = binned.groupBy("seq", "bin_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    return out.withColumn("t_gt", (F.col("t0") + F.col("t1")) / 2 if mid else F.col("t0"))


def adaptive_bins(motion: DataFrame) -> DataFrame:
    """Greedy bins: from row i to i + max(1, size_i), then on from there.

    ``motion``: (seq, idx, t, size) with the size from ``trajectory.adaptive_size``.
    """

    def step(state, row):
        last = (row["idx"], row["t"])
        if state is None:
            return {"n": 0, "t0": row["t"], "to": row["idx"] + max(1.0, row["size"]), "last": last, "seq": row["seq"]}, []
        state["last"] = last
        if row["idx"] < math.floor(state["to"]):
            return state, []
        done = {"seq": row["seq"], "bin_id": state["n"], "t0": state["t0"], "t1": row["t"]}
        return {"n": state["n"] + 1, "t0": row["t"], "to": row["idx"] + max(1.0, row["size"]), "last": last, "seq": row["seq"]}, [done]

    def finish(state):
        if state is None or state["last"][1] <= state["t0"]:
            return []
        return [{"seq": state["seq"], "bin_id": state["n"], "t0": state["t0"], "t1": state["last"][1]}]

    return folds.fold(motion.select("seq", "idx", "t", "size"), "seq", ["idx"], step, "seq string, bin_id int, t0 double, t1 double", finish)


def duration_windows(events: DataFrame, d: float) -> DataFrame:
    """Windows closed by the first event later than the last close by more than
    ``d``, that event included; they drift, and the trailing one is dropped."""

    def step(state, row):
        if state is None:
            return {"last": row["t"], "n": 1, "k": 0, "t0": row["t"]}, []
        state["n"] += 1
        if row["t"] > state["last"] + d:
            out = {"seq": row["seq"], "win": state["k"], "t0": state["t0"], "t1": row["t"], "n": state["n"]}
            return {"last": row["t"], "n": 0, "k": state["k"] + 1, "t0": row["t"]}, [out]
        return state, []

    return folds.fold(events.select("seq", "t", "event_id"), "seq", ["t", "event_id"], step, "seq string, win int, t0 double, t1 double, n long")


def min_gap_sample(rows: DataFrame, gap: float, tie: str = "event_id") -> DataFrame:
    """Keep a row if it is at least ``gap`` after the last one kept."""

    def step(state, row):
        if state is None or row["t"] - state["t"] >= gap:
            return {"t": row["t"]}, [{"seq": row["seq"], tie: row[tie], "t": row["t"]}]
        return state, []

    return folds.fold(rows.select("seq", "t", tie), "seq", ["t", tie], step, f"seq string, {tie} long, t double")


def gap_segments(rows: DataFrame, gap: float, tie: str = "event_id", width: float = 86_400.0) -> DataFrame:
    """A new segment after each gap over ``gap``; segments of one row are dropped. Times and
    counts are carried over the borders of buckets of ``width``, so no task holds a whole sequence."""
    from . import ranks

    x = ranks.with_bucket(rows, "t", width)
    by_bucket = W.partitionBy("seq").orderBy("_bucket")
    carry = x.groupBy("seq", "_bucket").agg(F.max("t").alias("_end")).withColumn("_carry", F.lag("_end").over(by_bucket)).drop("_end")
    w = W.partitionBy("seq", "_bucket").orderBy("t", tie)
    x = x.withColumn("_prev", F.lag("t").over(w)).join(carry, ["seq", "_bucket"])
    x = x.withColumn("_j", F.coalesce((F.col("t") - F.coalesce("_prev", "_carry") > gap).cast("int"), F.lit(0)))
    before = F.sum("_s").over(by_bucket.rowsBetween(W.unboundedPreceding, -1))
    base = x.groupBy("seq", "_bucket").agg(F.sum("_j").alias("_s")).withColumn("_base", F.coalesce(before, F.lit(0))).drop("_s")
    x = x.withColumn("_c", F.sum("_j").over(w)).join(base, ["seq", "_bucket"]).withColumn("segment", (F.col("_c") + F.col("_base")).cast("int")).select(*rows.columns, "segment")
    more = x.groupBy("seq", "segment").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return x.join(more, ["seq", "segment"], "left_semi").select(*rows.columns, "segment")


def crop_margin(rows: DataFrame, margin: float) -> DataFrame:
    """Rows at least ``margin`` from both ends of their sequence."""
    ends = rows.groupBy("seq").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return rows.join(ends, "seq").where((F.col("t") >= F.col("_a") + margin) & (F.col("t") <= F.col("_b") - margin)).drop("_a", "_b")


def after_first_motion(bins: DataFrame, motion: DataFrame) -> DataFrame:
    """Bins that start at or after the first row of their sequence with speed > 0."""
    first = motion.where("speed > 0").groupBy("seq").agg(F.min("t").alias("_first"))
    return bins.join(first, "seq").where(F.col("t0") >= F.col("_first")).drop("_first")


def tick_windows(events: DataFrame, ticks: DataFrame, delta: float) -> DataFrame:
    """Events of [t - delta, t) for each tick (seq, tick_id, tick_t)."""
    k = ticks.select("seq", "tick_id", "tick_t", (F.col("tick_t") - delta).alias("t0"), F.col("tick_t").alias("t1"))
    return interval_join(events, k, max(delta, 1e-9)).where(F.col("t") < F.col("t1")).drop("t0", "t1")


def tick_counts(events: DataFrame, ticks: DataFrame, delta: float, bucket: float) -> DataFrame:
    """(seq, tick_id, n): the number of events of [t - delta, t) for each tick (seq, tick_id, tick_t) that has any. Events are counted
    from the start of their sequence up to both ends, so that no event meets the ticks whose window it is in."""
    from . import joins, ranks

    e = ranks.global_rank(events, "seq", ["t", "event_id"], bucket, "_rank")
    seen = e.groupBy("seq", "t").agg(F.max("_rank").alias("_last"), F.min("_rank").alias("_first"))
    ends = ticks.select("seq", "tick_id", F.explode(F.array(F.struct((F.col("tick_t") - delta).alias("t"), F.lit(-1).alias("_sign")), F.struct(F.col("tick_t").alias("t"), F.lit(1).alias("_sign")))).alias("_e"))
    k = joins.asof(ends.select("seq", "tick_id", "_e._sign", "_e.t"), seen, "seq", "t", ["_last", "_first"], bucket)
    before = F.when(F.col("prev_t") == F.col("t"), F.col("prev__first")).otherwise(F.col("prev__last") + 1)
    return k.groupBy("seq", "tick_id").agg(F.sum(F.col("_sign") * F.coalesce(before, F.lit(0))).alias("n")).where("n > 0")


def tick_last(events: DataFrame, ticks: DataFrame, n: int, bucket: float) -> DataFrame:
    """The last ``n`` events before each tick (seq, tick_id, tick_t), as (tick_id, tick_t) beside them: an
    interval join of ranks, found per time ``bucket``."""
    from . import joins, ranks

    e = ranks.global_rank(events, "seq", ["t", "event_id"], bucket, "_rank")
    # the number of events before the tick: one more than the rank of the last of them
    seen = e.groupBy("seq", "t").agg(F.max("_rank").alias("_last"), F.min("_rank").alias("_first"))
    k = joins.asof(ticks.withColumnRenamed("tick_t", "t"), seen, "seq", "t", ["_last", "_first"], bucket)
    before = F.when(F.col("prev_t") == F.col("t"), F.col("prev__first")).otherwise(F.col("prev__last") + 1)
    k = k.select("seq", "tick_id", F.col("t").alias("tick_t"), F.coalesce(before, F.lit(0)).alias("_n"))
    k = k.where("_n > 0").select("seq", "tick_id", "tick_t", (F.col("_n") - n).cast("double").alias("t0"), (F.col("_n") - 1).cast("double").alias("t1"))
    found = interval_join(e.withColumn("_t", F.col("t")).withColumn("t", F.col("_rank").cast("double")), k, float(max(n, 1)))
    return found.withColumn("t", F.col("_t")).drop("_t", "_rank", "t0", "t1")


def strided(df: DataFrame, step: int, *axes: str) -> DataFrame:
    """Every ``step``-th index of each axis, numbered anew."""
    for a in axes:
        df = df.where(F.col(a) % step == 0).withColumn(a, F.floor(F.col(a) / step).cast("int"))
    return df


def crop_start(pose: DataFrame, least: float = 2.0, strict: bool = False) -> DataFrame:
    """(seq, start_idx): first row whose next displacement is at least ``least`` (``strict``: above it), else 0."""
    w = W.partitionBy("seq").orderBy("idx")
    d = F.sqrt((F.lead("e").over(w) - F.col("e")) ** 2 + (F.lead("n").over(w) - F.col("n")) ** 2)
    hit: Column = F.when(F.col("_d") > least if strict else F.col("_d") >= least, F.col("idx"))
    return pose.withColumn("_d", d).groupBy("seq").agg(F.coalesce(F.min(hit), F.lit(0)).cast("int").alias("start_idx"))


def slice_rows(df: DataFrame, start: int, end: int, incr: int, idx: str = "idx") -> DataFrame:
    """Rows [start:end:incr] of an index column."""
    return df.where((F.col(idx) >= start) & (F.col(idx) < end) & ((F.col(idx) - start) % incr == 0))
