"""Joins that Spark lacks: as-of, nearest in time or place, radius, guarded keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from . import ranks


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], width: float, direction: str = "backward", prefix: str = "prev_") -> DataFrame:
    """Left rows with the last right row at or before them (``backward``), or the
    first at or after them (``forward``), within ``by``.

    Both sides are merged in time order and the last right row is carried forward within buckets
    of ``width``; a small table carries it over bucket borders. One
    shuffle by (by, bucket); no task holds a whole sequence.
    """
    sign = 1 if direction == "backward" else -1
    names = [on, *values]
    lrow = left.select(F.struct(*left.columns).alias("_l"), F.lit(None).cast(_struct(right, names)).alias("_r"), F.col(by).alias(by), (sign * F.col(on)).alias("_t"), F.lit(1).alias("_side"))
    rrow = right.select(F.lit(None).cast(_struct(left, left.columns)).alias("_l"), F.struct(*names).alias("_r"), F.col(by).alias(by), (sign * F.col(on)).alias("_t"), F.lit(0).alias("_side"))
    # of right rows at one time the last by value wins, in either direction, compared value by value; null is the least
    order = ["_t", "_side", "_r"]
    both = lrow.unionByName(rrow)
    got = ranks.last_known(both, by, order, F.col("_r"), width, "_got").where("_side = 1")
    return got.select("_l.*", *(F.col(f"_got.{n}").alias(f"{prefix}{n}") for n in names))


def _struct(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{n}`:{kinds[n]}" for n in names) + ">"


def nearest_time(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], width: float, tie: str = "right") -> DataFrame:
    """Left rows with the right row nearest in time, as near_* columns; of two equally
    near, the later (``right``) or the earlier (``left``)."""
    a = asof(left, right, by, on, values, width, "backward", "_p_")
    b = asof(a, right, by, on, values, width, "forward", "_n_")
    back, ahead = F.col(on) - F.col(f"_p_{on}"), F.col(f"_n_{on}") - F.col(on)
    use_prev = F.col(f"_n_{on}").isNull() | (F.col(f"_p_{on}").isNotNull() & ((back < ahead) if tie == "right" else (back <= ahead)))
    out = b
    for n in [on, *values]:
        out = out.withColumn(f"near_{n}", F.when(use_prev, F.col(f"_p_{n}")).otherwise(F.col(f"_n_{n}")))
    return out.drop(*[f"_{s}_{n}" for s in "pn" for n in [on, *values]])


def interpolate(grid: DataFrame, track: DataFrame, by: str, on: str, values: list[str], width: float, outside: str = "extrapolate") -> DataFrame:
    """``values`` of ``track`` at the places of ``grid``, linear between neighbours.

    Beyond the ends: ``extrapolate`` by the end segments, ``null``, or ``clamp``.
    Needs two or more track rows of different ``on`` in each ``by``, else the one value.
    """
    # each track row knows its own segment, so that one backward join is enough
    w = W.partitionBy(by).orderBy(on)
    seg = track.select(by, on, *values)
    rn, cnt = F.row_number().over(w), F.count("*").over(W.partitionBy(by))
    # the last row points back, so that beyond the end its segment is the last one
    for n in [on, *values]:
        nxt = F.lead(n).over(w)
        seg = seg.withColumn(f"_to_{n}", nxt)
        seg = seg.withColumn(f"_lag_{n}", F.lag(n).over(w))
    seg = seg.withColumn("_i", rn).withColumn("_n", cnt)
    ends = seg.where("_i = 1").select(by, *(F.col(n).alias(f"_first_{n}") for n in [on, *values]), *(F.col(f"_to_{n}").alias(f"_second_{n}") for n in [on, *values]))
    extra = [f"_to_{n}" for n in [on, *values]] + [f"_lag_{n}" for n in [on, *values]]
    got = asof(grid, seg, by, on, [*values, *extra], width, "backward", "_b_").join(ends, by)
    t = F.col(on)
    out = got
    for v in values:
        def line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
            return F.when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (t - x0) * (y1 - y0) / (x1 - x0))

        inside = line(F.col(f"_b_{on}"), F.col(f"_b_{v}"), F.col(f"_b__to_{on}"), F.col(f"_b__to_{v}"))
        after = line(F.col(f"_b__lag_{on}"), F.col(f"_b__lag_{v}"), F.col(f"_b_{on}"), F.col(f"_b_{v}"))
        after = F.when(F.col(f"_b__lag_{on}").isNull(), F.col(f"_b_{v}")).otherwise(after)
        before = line(F.col(f"_first_{on}"), F.col(f"_first_{v}"), F.col(f"_second_{on}"), F.col(f"_second_{v}"))
        at_end = F.col(f"_b_{on}") == t
        beyond = {"extrapolate": after, "null": F.when(at_end, F.col(f"_b_{v}")), "clamp": F.col(f"_b_{v}")}[outside]
        ahead = {"extrapolate": before, "null": F.lit(None).cast("double"), "clamp": F.col(f"_first_{v}")}[outside]
        out = out.withColumn(f"_out_{v}", F.when(F.col(f"_b_{on}").isNull(), ahead).when(F.col(f"_b__to_{on}").isNull(), beyond).otherwise(inside))
    return out.select(*[c for c in grid.columns if c not in values], *(F.col(f"_out_{v}").alias(v) for v in values))


def radius_join(a: DataFrame, b: DataFrame, r: float, inclusive: bool = True) -> DataFrame:
    """Pairs of a (q, qe, qn) and b (r, re, rn) within a radius, with their distance.

    Cells of the radius' size make it an equi-join: b is sent to its own and the
    eight cells around, a to its own.
    """
    cell = lambda c: F.floor(F.col(c) / r)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = a.withColumn("_cx", cell("qe")).withColumn("_cy", cell("qn"))
    right = b.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", cell("re") + F.col("_dx")).withColumn("_cy", cell("rn") + F.col("_dy")).drop("_dx", "_dy")
    d = F.sqrt((F.col("qe") - F.col("re")) ** 2 + (F.col("qn") - F.col("rn")) ** 2)
    out = left.join(right, ["_cx", "_cy"]).withColumn("dist", d)
    return out.where(F.col("dist") <= r if inclusive else F.col("dist") < r).drop("_cx", "_cy")


def nearest_place(a: DataFrame, b: DataFrame, start: float | None = None) -> DataFrame:
    """For each a (q, qe, qn) the nearest b (r, re, rn), smallest r on ties.

    By radius joins of growing radius: a row that finds any b within the radius has its nearest among them and is done;
    only the others try again with twice the radius. ``start``: the first radius, else about the spacing of b. Rows without
    finite coordinates are left out on both sides.
    """
    finite = lambda df, x, y: df.where(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    left, b = finite(a.select("q", F.col("qe").cast("double").alias("qe"), F.col("qn").cast("double").alias("qn")), "qe", "qn"), finite(b, "re", "rn")
    ends = b.agg(F.count("*"), F.min("re"), F.max("re"), F.min("rn"), F.max("rn")).head()
    own = left.agg(F.min("qe"), F.max("qe"), F.min("qn"), F.max("qn")).head()
    out = left.join(b, F.lit(False)).select("q", "r", F.lit(0.0).alias("dist"))
    if not ends[0] or own[0] is None:
        return out
    wide, high = ends[2] - ends[1], ends[4] - ends[3]
    far = math.hypot(max(own[1], ends[2]) - min(own[0], ends[1]), max(own[3], ends[4]) - min(own[2], ends[3]))
    radius = start or max(math.sqrt(wide * high / ends[0]), max(wide, high) / ends[0], far / (1 << 20)) or 1.0
    while True:
        best = radius_join(left, b, radius).groupBy("q").agg(F.min(F.struct("dist", "r")).alias("_m"))
        found = session.stored(best.select("q", F.col("_m.r").alias("r"), F.col("_m.dist").alias("dist")), "nearest")
        out = out.unionByName(found)
        if radius > far:
            return out
        left = session.stored(left.join(found.select("q"), "q", "left_anti"), "unmatched")
        if not left.head(1):
            return out
        radius *= 2


def nearest_place_within(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """For each a (q, qe, qn) the nearest b (r, re, rn) nearer than ``r``, smallest r on ties: a radius join,
    of which partial aggregation keeps one row per query and task."""
    near = radius_join(a, b, r, inclusive=False).groupBy("q").agg(F.min(F.struct("dist", "r")).alias("_m"))
    return near.select("q", F.col("_m.r").alias("r"), F.col("_m.dist").alias("dist"))


def unmatched(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (already normalised) keys are not done: an anti join."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def match_unique(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that b holds exactly once."""
    one = b.withColumn("_c", F.count("*").over(W.partitionBy(*keys))).where("_c = 1").drop("_c")
    return a.join(one, keys)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Dictionary lookup with fallback to the value itself."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)
