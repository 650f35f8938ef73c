"""Kinematics of position tracks (seq, idx, t, e, n)."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds, joins


def by():
    return W.partitionBy("seq").orderBy("idx")


def to_utm(track: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds e, n: Universal Transverse Mercator by the series of Snyder (1987) on
    WGS 84; zone and hemisphere are those of each sequence's first point."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    first = track.groupBy("seq").agg(F.min(F.struct("idx", F.col(lat).alias("la"), F.col(lon).alias("lo"))).alias("_f"))
    zone = F.floor((F.col("_f.lo") + 180) / 6) + 1
    rows = track.join(first, "seq").withColumn("_lon0", F.radians(zone * 6 - 183)).withColumn("_south", F.col("_f.la") < 0)
    p = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.sin(p) ** 2)
    t, c = F.tan(p) ** 2, ep * F.cos(p) ** 2
    d = (F.radians(lon) - F.col("_lon0")) * F.cos(p)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p)
        - (35 * e2**3 / 3072) * F.sin(6 * p)
    )
    east = k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * d**5 / 120) + 500000
    north = k0 * (m + n * F.tan(p) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * d**6 / 720))
    return rows.withColumn("e", east).withColumn("n", north + F.when(F.col("_south"), 1e7).otherwise(0.0)).drop("_f", "_lon0", "_south")


def uniform_grid(track: DataFrame, step: float) -> DataFrame:
    """(seq, idx, t): times from a track's first to before its last, by ``step``."""
    ends = track.groupBy("seq").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    n = F.ceil((F.col("_b") - F.col("_a")) / step).cast("int")
    return ends.where(n > 0).select("seq", "_a", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select("seq", "idx", (F.col("_a") + F.col("idx") * step).alias("t"))


def resample(track: DataFrame, step: float, width: float) -> DataFrame:
    """The track at uniform times, linear in between."""
    return joins.interpolate(uniform_grid(track, step), track, "seq", "t", ["e", "n"], width)


def step_length(a: str = "e", b: str = "n") -> Column:
    return F.sqrt((F.col(a) - F.lag(a).over(by())) ** 2 + (F.col(b) - F.lag(b).over(by())) ** 2)


def arc_length(track: DataFrame) -> DataFrame:
    return track.withColumn("_d", F.coalesce(step_length(), F.lit(0.0))).withColumn("s", F.sum("_d").over(by())).drop("_d")


def resample_by_distance(track: DataFrame, spacing: float) -> DataFrame:
    """(seq, k, s, e, n, t): points each ``spacing`` along the path."""
    path = arc_length(track).withColumn("_len", F.max("s").over(W.partitionBy("seq")))
    # of several rows at one place the last begins the next segment
    nxt = lambda c: F.lead(c).over(by())
    seg = path.select("seq", "s", "e", "n", "t", "_len", nxt("s").alias("s1"), nxt("e").alias("e1"), nxt("n").alias("n1"), nxt("t").alias("t1"))
    k0, k1 = F.ceil(F.col("s") / spacing), F.when(F.col("s1").isNull(), F.floor(F.col("s") / spacing)).otherwise(F.ceil(F.col("s1") / spacing) - 1)
    ks = F.when(k1 >= k0, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))
    at = seg.withColumn("k", F.explode(ks)).withColumn("at", F.col("k") * spacing)
    lerp = lambda a, b: F.when(F.col("s1").isNull() | (F.col("s1") == F.col("s")), F.col(a)).otherwise(F.col(a) + (F.col("at") - F.col("s")) * (F.col(b) - F.col(a)) / (F.col("s1") - F.col("s")))
    return at.select("seq", F.col("k").cast("int").alias("k"), F.col("at").alias("s"), lerp("e", "e1").alias("e"), lerp("n", "n1").alias("n"), lerp("t", "t1").alias("t"))


def _direction(dn: pa.Array, de: pa.Array) -> pa.Array:
    """atan2 of the C library: that of the JVM has another last bit in about one of six rows, which shows where turns of some 1e-15 are divided by no time."""
    return pa.array([None if y is None or x is None else math.atan2(y, x) for y, x in zip(dn.to_pylist(), de.to_pylist())], pa.float64())


def headings(track: DataFrame, least: float = 1e-3) -> DataFrame:
    """Adds heading: atan2 of the step into each row where it is long enough,
    else the last one known; the first rows take the first one known; 0 without motion."""
    de, dn = F.col("e") - F.lag("e").over(by()), F.col("n") - F.lag("n").over(by())
    x = track.withColumn("_h", F.when(F.sqrt(de**2 + dn**2) >= least, F.arrow_udf(_direction, "double")(dn, de)))
    known = F.last("_h", ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, 0))
    first = F.first("_h", ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return x.withColumn("heading", F.coalesce(known, first, F.lit(0.0))).drop("_h")


def angular_velocity(track: DataFrame, window: int = 100, most: float = math.pi / 6) -> DataFrame:
    """Adds ang_vel: unwrapped heading change over ``window`` rows, 0 before row window + 1, clipped."""
    d = F.col("heading") - F.lag("heading").over(by())
    turned = F.col("_d") + math.pi
    wrapped = turned - F.floor(turned / (2 * math.pi)) * 2 * math.pi - math.pi
    # half a turn keeps its direction, up to what the sum above is off by
    wrapped = F.when((F.abs(wrapped + math.pi) < 1e-15) & (F.col("_d") > 0), F.lit(math.pi)).otherwise(wrapped)
    x = track.withColumn("_d", d).withColumn("_d", F.coalesce(wrapped, F.col("heading")))
    x = folds.running_sum(x, "seq", ["idx"], "_d", "_u").drop("_d")
    turn, time = F.col("_u") - F.lag("_u", window).over(by()), F.col("t") - F.lag("t", window).over(by())
    # no time in between: infinite, or NaN without a turn
    w = F.when(time == 0, turn * float("inf")).otherwise(turn / F.when(time == 0, 1.0).otherwise(time))
    w = F.when(F.row_number().over(by()) - 1 >= window + 1, w).otherwise(0.0)
    return x.withColumn("ang_vel", F.least(F.greatest(w, F.lit(-most)), F.lit(most))).drop("_u")


def speeds(track: DataFrame) -> DataFrame:
    """Adds speed: step over time; the first row takes the second's."""
    v = step_length() / F.greatest(F.col("t") - F.lag("t").over(by()), F.lit(1e-6))
    x = track.withColumn("_v", v)
    return x.withColumn("speed", F.coalesce(F.col("_v"), F.lead("_v").over(by()))).drop("_v")


def _fitted(t: np.ndarray, y: np.ndarray, h: int, singular: float | None) -> tuple[np.ndarray, np.ndarray]:
    """At each row the linear coefficient of the quadratic that fits ``y`` over time best on ``h`` rows to each side, and whether a value
    is missing there. 0 for fewer than 3 rows. Sums are added up row by row and powers are those of the C library: near such windows every digit of theirs shows."""
    around = lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, h, constant_values=np.nan), 2 * h + 1)
    u = around(t) - t[:, None]
    there = ~np.isnan(u)
    lacks = (there & np.isnan(around(y))).any(1)
    u, y = np.where(there, u, 0.0), np.where(there, around(y), 0.0)
    pow_ = np.frompyfunc(math.pow, 2, 1)
    power = [there.astype(float), u, *(pow_(u, k).astype(float) for k in (2.0, 3.0, 4.0))]

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += x[:, k]
        return out

    s = [total(p) for p in power]
    f = [total(p * y) for p in power[:3]]
    # normal equations [s0 s1 s2; s1 s2 s3; s2 s3 s4] (c0 c1 c2) = (f0 f1 f2), by Cramer's rule
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    top = s[0] * (f[1] * s[4] - s[3] * f[2]) - f[0] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * f[2] - f[1] * s[2])
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = top / det
    if singular is not None:
        fit = np.where(det == 0, singular, fit)
    return np.where(s[0] >= 3, fit, 0.0), lacks & (s[0] >= 3)


def slopes(track: DataFrame, values: dict[str, str], window: int, span: int = 4096, singular: float | None = 0.0) -> DataFrame:
    """Adds, for each value under its name, the linear coefficient of a local quadratic least-squares fit over time, on ``window // 2``
    rows to each side; 0 for fewer than 3 rows, null where a value in the window is. Rows of fewer than three times have no one fit: ``singular``,
    or what the division by zero gives (infinite or NaN) if that is None. Rows are numbered as they
    stream by, and stretches of ``span`` rows, with those beside them that their windows reach, are fitted as arrays."""
    h = window // 2
    if h > span:
        raise ValueError("a window is to be shorter than a stretch")
    rows = track.withColumn("_k", F.row_number().over(by()) - 1)
    near = F.transform(F.array(F.col("_k") - h, F.col("_k"), F.col("_k") + h), lambda k: F.floor(F.greatest(k, F.lit(0)) / span))
    spread = rows.withColumn("_b", F.explode(F.array_distinct(near)))
    names = track.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_k", "ascending")]))
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        own = table.column("_k").to_numpy() // span == table.column("_b")[0].as_py()
        out = table.select(names).filter(pa.array(own))
        for value, name in values.items():
            v, lacks = (x[own] for x in _fitted(number("t"), number(value), h, singular))
            out = out.append_column(name, pa.array(v, mask=lacks))
        return out

    kinds = [*(f"`{n}` {k}" for n, k in track.dtypes), *(f"`{n}` double" for n in values.values())]
    return spread.groupBy("seq", "_b").applyInArrow(run, ", ".join(kinds))


def adaptive_size(track: DataFrame, ang_vel_max: float = 0.5, lin_speed_max: float = 20.0, ang_acc_max: float = 0.5, lin_acc_max: float = 2.5, min_bins: float = 1, max_bins: float = 20, weights: tuple[float, float, float, float] = (0.5, 0.2, 0.3, 0.0), exponential: bool = False) -> DataFrame:
    """Adds size: small bins in strong motion, the largest when nearly still. The
    maxima go by name: (ang_vel, lin_speed, ang_acc, lin_acc)."""
    unit = lambda c, m: F.least(F.greatest(c / m, F.lit(0.0)), F.lit(1.0))
    m = weights[0] * unit(F.abs("ang_vel"), ang_vel_max) + weights[1] * unit(F.col("speed"), lin_speed_max) + weights[2] * unit(F.abs("ang_acc"), ang_acc_max) + weights[3] * unit(F.abs("lin_acc"), lin_acc_max)
    size = F.rint(max_bins * F.exp(-m * math.log(max_bins / min_bins))) if exponential else max_bins - m * (max_bins - min_bins)
    size = F.greatest(F.lit(float(min_bins)), F.least(size, F.lit(float(max_bins))))
    still = (F.col("speed") < 0.5) & (F.abs("ang_vel") < 0.05)
    return track.withColumn("size", F.when(still, float(max_bins)).otherwise(size))


def first_self_loop(track: DataFrame, radius: float = 10.0, gap: int = 20) -> DataFrame:
    """(seq, i, j): the smallest j >= gap with an i < j - gap nearer than ``radius``,
    and the nearest such i. Sequences without a loop have no row."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = track.select("seq", "idx", "e", "n", cell("e").alias("cx"), cell("n").alias("cy"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = p.select("seq", F.col("idx").alias("i"), F.col("e").alias("ie"), F.col("n").alias("in_"), "cx", "cy").withColumn("_x", F.explode(near)).withColumn("_y", F.explode(near))
    a = a.select("seq", "i", "ie", "in_", (F.col("cx") + F.col("_x")).alias("cx"), (F.col("cy") + F.col("_y")).alias("cy"))
    d = F.sqrt((F.col("e") - F.col("ie")) ** 2 + (F.col("n") - F.col("in_")) ** 2)
    hit = p.join(a, ["seq", "cx", "cy"]).where((F.col("i") < F.col("idx") - gap) & (F.col("idx") >= gap)).withColumn("d", d).where(F.col("d") < radius)
    return hit.groupBy("seq").agg(F.min(F.struct(F.col("idx").alias("j"), "d", "i")).alias("m")).select("seq", F.col("m.i").alias("i"), F.col("m.j").alias("j"))


def displacement_stats(frames: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of the distance between consecutive frames."""
    w = W.partitionBy(*keys).orderBy("idx")
    d = F.sqrt((F.lead("e").over(w) - F.col("e")) ** 2 + (F.lead("n").over(w) - F.col("n")) ** 2)
    x = frames.withColumn("_d", d)
    return x.groupBy(*keys).agg(F.count("*").alias("num_frames"), F.avg("_d").alias("mean_displacement"), F.stddev_pop("_d").alias("std_displacement"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, arcsin: bool = False) -> Column:
    """Great-circle distance in metres on a sphere of 6,371 km."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 6371000.0 * 2 * (F.asin(F.sqrt(a)) if arcsin else F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def angle_diff(a: Column, b: Column) -> Column:
    """a - b in degrees, wrapped to [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def in_box(df: DataFrame, e: tuple[float, float], n: tuple[float, float]) -> DataFrame:
    return df.where((F.col("e") > e[0]) & (F.col("e") < e[1]) & (F.col("n") > n[0]) & (F.col("n") < n[1]))


def _tour(xy: np.ndarray, rings: int = 8) -> np.ndarray:
    """The order of a greedy tour from the first point. Points left stand in cells about as large as their spacing; rings of cells around the
    last point are searched until none farther out can be nearer, and all points where ``rings`` hold none."""
    n = len(xy)
    low, size = xy.min(0), xy.max(0) - xy.min(0)
    cell = max(math.sqrt(size[0] * size[1] / n), size.max() / n) or 1.0
    place = np.floor((xy - low) / cell).astype(np.int64)
    wide, high = (int(k) + 1 for k in place.max(0))  # at most about 3 n cells
    own = place[:, 0] * high + place[:, 1]
    # numbers as flat arrays, some 100 bytes a point: the points of each cell one behind the other, those left first
    flat = lambda kind, x: array(kind, np.ascontiguousarray(x).tobytes())
    by_cell, per_cell = np.argsort(own, kind="stable"), np.bincount(own, minlength=wide * high)
    slot = np.empty(n, np.int64)
    slot[by_cell] = np.arange(n)
    start, number = flat("q", np.cumsum(per_cell) - per_cell), flat("q", per_cell)
    members, slot, xs, ys = flat("q", by_cell), flat("q", slot), flat("d", xy[:, 0].astype(float)), flat("d", xy[:, 1].astype(float))
    left, order, at = np.ones(n, bool), np.zeros(n, np.int64), 0
    for step in range(1, n):
        c = int(own[at])
        number[c] -= 1
        last, free = members[start[c] + number[c]], slot[at]
        members[free], slot[last] = last, free
        left[at] = False
        x, y, (i, j), best = xs[at], ys[at], divmod(c, high), (math.inf, -1)
        for ring in range(rings + 1):
            edge = [(i + a, j + b) for a in range(-ring, ring + 1) for b in ((-ring, ring) if -ring < a < ring else range(-ring, ring + 1))] if ring else [(i, j)]
            for a, b in edge:
                if 0 <= a < wide and 0 <= b < high:
                    c = a * high + b
                    for k in members[start[c] : start[c] + number[c]]:
                        dx, dy = xs[k] - x, ys[k] - y
                        best = min(best, (math.sqrt(dx * dx + dy * dy), k))
            if best[0] < ring * cell * (1 - 1e-9):  # what lies in later rings is farther away
                break
        else:
            rest = np.flatnonzero(left)
            d = xy[rest] - xy[at]
            best = (0.0, int(rest[np.argmin(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]))]))
        order[step] = at = best[1]
    return order


def greedy_tour(track: DataFrame) -> DataFrame:
    """(seq, ord, idx): from idx order's first point always on to the nearest one
    left, the earlier on ties. Each step depends on the one before, so a sequence
    is one group; it holds the points of one traverse, and steps look at near points only."""

    def run(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_numpy()
        by_idx = np.argsort(idx, kind="stable")
        xy = np.stack([table.column(c).to_numpy()[by_idx].astype(float) for c in "en"], 1)
        order = by_idx[_tour(xy)]
        seq = pa.DictionaryArray.from_arrays(np.zeros(len(order), np.int32), table.column("seq").slice(0, 1).combine_chunks()).cast(pa.string())
        return pa.table([seq, pa.array(np.arange(len(order), dtype=np.int32)), pa.array(idx[order].astype(np.int32))], names=["seq", "ord", "idx"])

    return track.select("seq", "idx", "e", "n").groupBy("seq").applyInArrow(run, "seq string, ord int, idx int")


def most_overlapping(track: DataFrame, radius: float = 5.0) -> DataFrame:
    """(a, b, overlap): the pair of sequences a < b with most points of b that
    have a point of a nearer than ``radius``; the first pair on ties."""
    q = track.select(F.struct("seq", "idx").alias("q"), F.col("e").alias("qe"), F.col("n").alias("qn"))
    r = track.select(F.struct("seq", "idx").alias("r"), F.col("e").alias("re"), F.col("n").alias("rn"))
    hit = joins.radius_join(q, r, radius, inclusive=False).where(F.col("r.seq") < F.col("q.seq"))
    n = hit.select(F.col("r.seq").alias("a"), F.col("q.seq").alias("b"), F.col("q.idx").alias("i")).distinct().groupBy("a", "b").agg(F.count("*").alias("overlap"))
    return n.orderBy(F.col("overlap").desc(), "a", "b").limit(1)


def nmea_filter(points: DataFrame, least: float = 1.0) -> DataFrame:
    """Points (seq, idx, lat, lon) that differ from the last accepted one in both
    coordinates and lie more than ``least`` metres away; zeros are dropped."""

    def step(state, row):
        la, lo = row["lat"], row["lon"]
        if not la or not lo or la == (state or {}).get("lat", 0.0) or lo == (state or {}).get("lon", 0.0):
            return state, []
        if state is not None:
            p, q = math.radians(state["lat"]), math.radians(la)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lo - state["lon"]) / 2) ** 2
            if 2 * 6371000.0 * math.asin(math.sqrt(h)) <= least:
                return state, []
        return {"lat": la, "lon": lo}, [{"seq": row["seq"], "idx": row["idx"], "lat": la, "lon": lo}]

    return folds.fold(points.select("seq", "idx", "lat", "lon"), "seq", ["idx"], step, "seq string, idx int, lat double, lon double")
