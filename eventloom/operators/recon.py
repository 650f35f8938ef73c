"""Per-bin aggregates of events into sparse frames.

Input: binned events (seq, bin_id, t, x, y, p, event_id). Output: one row per
pixel that events touched; what an untouched pixel holds is said per operator.
All are hash aggregations with partial sums before the shuffle; windows only
run over the pixels of one frame, whose number the sensor bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME = ["seq", "bin_id"]
PIXEL = [*FRAME, "y", "x"]
TIME = ["t", "event_id"]


def on_sensor(events: DataFrame, width: int, height: int) -> DataFrame:
    return events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def _by_max(v: Column, top: Column) -> Column:
    scaled = F.least(F.greatest(v / (top + 1e-6) * 255, F.lit(0.0)), F.lit(255.0))
    return F.when(top == 0, 0).otherwise(F.floor(scaled)).cast("int")


def polarity_histogram(events: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, channel, y, x, v): tanh of counts over each channel's maximum, as
    0..255. Channel R holds OFF and G holds ON; polarity -1 counts as ON. Untouched: 0."""
    p = F.pmod(F.col("p"), F.lit(2))
    c = on_sensor(events, width, height).groupBy(*PIXEL, p.alias("_p")).agg(F.tanh(F.count("*").cast("double")).alias("_v"))
    top = F.max("_v").over(W.partitionBy(*FRAME, "_p"))
    return c.select(*PIXEL, F.when(F.col("_p") == 0, "R").otherwise("G").alias("channel"), _by_max(F.col("_v"), top).alias("v"))


def count_image(events: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, y, x, v): trunc((tanh(count) + 1) / 2 * 255). Untouched: 127."""
    c = on_sensor(events, width, height).groupBy(*PIXEL).agg(F.count("*").cast("double").alias("_c"))
    return c.select(*PIXEL, F.floor((F.tanh("_c") + 1) / 2 * 255).cast("int").alias("v"))


def time_surface(events: DataFrame, width: int, height: int, tau: float = 0.1) -> DataFrame:
    """(frame, channel, y, x, v): exponential decay since a pixel's last event, as
    0..255 of its channel's maximum. Channel R holds ON and G holds OFF. Untouched: 0.
    Events off the sensor or of another polarity count for nothing, the frame's end included."""
    valid = on_sensor(events, width, height).where(F.col("p").isin(0, 1))
    last = valid.groupBy(*PIXEL, "p").agg(F.max("t").alias("_t"))
    end = valid.groupBy(*FRAME).agg(F.max("t").alias("_end"))
    s = F.exp(-((F.col("_end") + tau) - F.col("_t")) / tau)
    v = last.join(end, FRAME).withColumn("_v", F.tanh(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))))
    top = F.max("_v").over(W.partitionBy(*FRAME, "p"))
    return v.select(*PIXEL, F.when(F.col("p") == 1, "R").otherwise("G").alias("channel"), _by_max(F.col("_v"), top).alias("v"))


def polarity_gradient(events: DataFrame, tau: float) -> DataFrame:
    """(frame, y, x, maintain, transition): decayed counts of events that keep and
    that flip a pixel's polarity; a pixel's first event only sets its state."""
    pos = (F.col("p") > 0).cast("int")
    end = F.max("t").over(W.partitionBy(*FRAME))
    prev = F.lag(pos).over(W.partitionBy(*PIXEL).orderBy(*TIME))
    e = events.select(*PIXEL, pos.alias("_p"), prev.alias("_q"), F.exp(-(end - F.col("t")) / tau).alias("_d"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("_d"))), F.lit(0.0))
    return e.groupBy(*PIXEL).agg(some(F.col("_p") == F.col("_q")).alias("maintain"), some(F.col("_p") != F.col("_q")).alias("transition"))


def transition_counts(events: DataFrame) -> DataFrame:
    """(frame, y, x, off_on, on_off, same): undecayed counts per pixel."""
    pos = (F.col("p") > 0).cast("int")
    prev = F.lag(pos).over(W.partitionBy(*PIXEL).orderBy(*TIME))
    e = events.select(*PIXEL, pos.alias("_p"), prev.alias("_q"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return e.groupBy(*PIXEL).agg(n((F.col("_q") == 0) & (F.col("_p") == 1)).alias("off_on"), n((F.col("_q") == 1) & (F.col("_p") == 0)).alias("on_off"), n(F.col("_q") == F.col("_p")).alias("same"))


def spike_tensor(events: DataFrame, unit: float, taps: int = 50, gain: float = 2.0, decay: float = 0.1) -> DataFrame:
    """(frame, y, x, v): signed events in bins of ``unit``, filtered per pixel with
    gain * exp(-decay * k), k < taps, at the frame's last bin."""
    k = F.floor(F.col("t") / unit)
    last = F.max(k).over(W.partitionBy(*FRAME))
    e = events.select(*PIXEL, F.when(F.col("p") > 0, 1.0).otherwise(-1.0).alias("_s"), (last - k).alias("_k")).where(F.col("_k") < taps)
    return e.groupBy(*PIXEL).agg(F.sum(F.col("_s") * gain * F.exp(-decay * F.col("_k"))).alias("v"))


def signed_decay(events: DataFrame, tau: float, most: float = 10.0) -> DataFrame:
    """(frame, y, x, v): sum of sign * exp(-min(dt, most) / tau), dt before the frame's end."""
    end = F.max("t").over(W.partitionBy(*FRAME))
    dt = F.least(end - F.col("t"), F.lit(most))
    e = events.select(*PIXEL, (F.when(F.col("p") > 0, 1.0).otherwise(-1.0) * F.exp(-dt / tau)).alias("_v"))
    return e.groupBy(*PIXEL).agg(F.sum("_v").alias("v"))


def voxel_grid(events: DataFrame, bins: int) -> DataFrame:
    """(frame, ti, y, x, v): polarity split bilinearly between two time bins."""
    ends = events.groupBy(*FRAME).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    span = F.when(F.col("_b") == F.col("_a"), 1.0).otherwise(F.col("_b") - F.col("_a"))
    at = (bins - 1) * (F.col("t") - F.col("_a")) / span
    e = events.join(ends, FRAME).select(*PIXEL, at.alias("_at"), F.when(F.col("p") == 0, -1.0).otherwise(F.col("p").cast("double")).alias("_p"))
    lo, part = F.floor("_at").cast("int"), F.col("_at") - F.floor("_at")
    both = F.array(F.struct(lo.alias("ti"), (F.col("_p") * (1 - part)).alias("v")), F.struct((lo + 1).alias("ti"), (F.col("_p") * part).alias("v")))
    return e.select(*PIXEL, F.inline(both)).where((F.col("ti") >= 0) & (F.col("ti") < bins)).groupBy(*FRAME, "ti", "y", "x").agg(F.sum("v").alias("v"))


def normalise_voxels(voxels: DataFrame, hot: DataFrame | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """Non-zero cells to mean 0 and deviation 1 per frame; hot pixels (x, y) are
    taken out first; with a size given, frames are flipped both ways. If a frame
    has no spread, its cells are 0."""
    v = voxels if hot is None else voxels.join(hot, ["x", "y"], "left_anti")
    v = v.where("v <> 0")
    w = W.partitionBy(*FRAME)
    mean = F.avg("v").over(w)
    std = F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")).over(w) - mean * mean, F.lit(0.0)))
    out = v.withColumn("_m", mean).withColumn("_s", std)
    out = out.withColumn("v", F.when(F.col("_s") < 1e-9, 0.0).otherwise((F.col("v") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")
    if height is not None and width is not None:
        out = out.withColumn("y", height - 1 - F.col("y")).withColumn("x", width - 1 - F.col("x"))
    return out.select(*FRAME, "ti", "y", "x", "v")


def rescale_intensity(frames: DataFrame, n: int) -> DataFrame:
    """Pixels (seq, bin_id, y, x, v in 0..1) to 0..255 between smoothed bounds: each
    frame's minimum clipped to [0, .45] and maximum to [.55, 1], and the medians
    of those over the frame and its last ``n``."""
    lo = F.least(F.greatest(F.min("v"), F.lit(0.0)), F.lit(0.45))
    hi = F.least(F.greatest(F.max("v"), F.lit(0.55)), F.lit(1.0))
    w = W.partitionBy("seq").orderBy("bin_id").rowsBetween(-n, 0)
    bounds = frames.groupBy(*FRAME).agg(lo.alias("_lo"), hi.alias("_hi"))
    bounds = bounds.select(*FRAME, F.expr("percentile(_lo, 0.5)").over(w).alias("lo"), F.expr("percentile(_hi, 0.5)").over(w).alias("hi"))
    v = 255 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return frames.join(bounds, FRAME).select(*PIXEL, F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))


def robust_normalise(frames: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Pixels to 0..1 between two percentiles of their frame, clipped."""
    p = frames.groupBy(*FRAME).agg(F.percentile("v", F.lit(low)).alias("_lo"), F.percentile("v", F.lit(high)).alias("_hi"))
    v = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return frames.join(p, FRAME).where("_hi > _lo").select(*PIXEL, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("v"))


def preview(voxels: DataFrame, bins: int, last: int, signed: bool = True) -> DataFrame:
    """Sum of the last time bins of a voxel grid: its sign, or a gray of 0..255
    over the range -10..10. Sums within 1e-6 of 0 are 0."""
    s = voxels.where(F.col("ti") >= bins - last).groupBy(*PIXEL).agg(F.round(F.sum("v"), 6).alias("_v"))
    if signed:
        return s.select(*PIXEL, F.signum("_v").cast("int").alias("v"))
    return s.select(*PIXEL, F.floor(F.least(F.greatest(255 * (F.col("_v") + 10) / 20, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))
