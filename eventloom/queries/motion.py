"""Trajectories, kinematics and joins in time and place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, joins, trajectory
from ..sources import tables as T
from . import query
from .ctes import DESC, EV, MOTION, POSE

DAY = 86400.0


def _r(df, digits, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits) + 0.0)
    return df


def _scaled_round(x, digits):
    """Rounded as the SQL does it, on the scaled double: ``F.round`` goes by decimals, and of numbers near a tie, or so large that no
    digit is left to round, it may give another double. Infinite and NaN stay."""
    y = x * 10.0**digits
    whole = F.when(F.abs(y) < 2.0**52, F.signum(y) * F.floor(F.abs(y) + 0.5)).otherwise(y)
    return whole / 10.0**digits + 0.0


def _motion(spark, d):
    return trajectory.speeds(trajectory.angular_velocity(trajectory.headings(T.pose(spark, d)), 10))


def _geo(spark, d):
    return T.pose(spark, d).select("seq", "idx", "t", (F.col("n") / 1000 - 27.4).alias("lat"), (F.col("e") / 1000 + 152.9).alias("lon"))


GEO = POSE + ", geo AS (SELECT seq, idx, t, n / 1000 - 27.4::DOUBLE AS lat, e / 1000 + 152.9::DOUBLE AS lon FROM pose)"


@query(f"""WITH {GEO}, z AS (SELECT *, (floor((first_value(lon) OVER w + 180) / 6) + 1) * 6 - 183 AS l0, first_value(lat) OVER w < 0 AS south FROM geo WINDOW w AS (PARTITION BY seq ORDER BY idx)),
k AS (SELECT *, radians(lat) AS p, (radians(lon) - radians(l0)) * cos(radians(lat)) AS d, 0.0066943799901413165::DOUBLE AS e2, 0.0066943799901413165::DOUBLE / (1 - 0.0066943799901413165::DOUBLE) AS ep FROM z),
s AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t2, ep * cos(p) * cos(p) AS c,
  6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * p)
    + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * p) - (35 * e2 * e2 * e2 / 3072) * sin(6 * p)) AS m FROM k)
SELECT seq, idx, round(0.9996 * n * (d + (1 - t2 + c) * d ** 3 / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c - 58 * ep) * d ** 5 / 120) + 500000, 3) AS e,
  round(0.9996 * (m + n * tan(p) * (d * d / 2 + (5 - t2 + 9 * c + 4 * c * c) * d ** 4 / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c - 330 * ep) * d ** 6 / 720)) + CASE WHEN south THEN 1e7 ELSE 0 END, 3) AS n FROM s""")
def o1_utm(spark, d):
    return _r(trajectory.to_utm(_geo(spark, d)).select("seq", "idx", "e", "n"), 3, "e", "n")


GRID = """g AS (SELECT seq, i::INT AS idx, a + i * 7200.0::DOUBLE AS t FROM (SELECT seq, a, unnest(range(ceil((z - a) / 7200.0)::BIGINT)) AS i FROM (SELECT seq, min(t) AS a, max(t) AS z FROM pose GROUP BY seq)))"""


@query(f"""WITH {POSE}, {GRID}, sg AS (SELECT *, lead(t) OVER w AS t1, lead(e) OVER w AS e1, lead(n) OVER w AS n1 FROM pose WINDOW w AS (PARTITION BY seq ORDER BY t))
SELECT g.seq, g.idx, round(g.t, 3) AS t, round(e + (g.t - sg.t) * (e1 - e) / (t1 - sg.t), 4) + 0.0 AS e, round(n + (g.t - sg.t) * (n1 - n) / (t1 - sg.t), 4) + 0.0 AS n
FROM g JOIN sg ON g.seq = sg.seq AND g.t >= sg.t AND g.t < t1""")
def o2_resample_time(spark, d):
    return _r(_r(trajectory.resample(T.pose(spark, d), 7200.0, DAY), 3, "t"), 4, "e", "n")


def _outside(spark, d, how):
    track = T.pose(spark, d)
    grid = track.groupBy("seq").agg(F.min("t").alias("a"), F.max("t").alias("z")).select("seq", F.posexplode(F.array(F.col("a") - 5000, "a", F.col("a") + 4321, "z", F.col("z") + 5000)).alias("idx", "t"))
    return _r(joins.interpolate(grid, track, "seq", "t", ["e", "n"], DAY, how).drop("t"), 3, "e", "n")


OUTSIDE = f"""{POSE}, en AS (SELECT seq, min(t) AS a, max(t) AS z FROM pose GROUP BY seq),
g AS (SELECT seq, unnest([0, 1, 2, 3, 4])::INT AS idx, unnest([a - 5000, a, a + 4321, z, z + 5000]) AS t FROM en),
sg AS (SELECT *, lead(t) OVER w AS t1, lead(e) OVER w AS e1, lead(n) OVER w AS n1 FROM pose WINDOW w AS (PARTITION BY seq ORDER BY t)),
us AS (SELECT g.*, en.a, en.z, CASE WHEN g.t < en.a THEN en.a ELSE g.t END AS tt FROM g JOIN en USING (seq)),
pk AS (SELECT us.seq, us.idx, us.t, us.a, us.z, s.t AS st, s.e, s.n, s.t1, s.e1, s.n1 FROM us JOIN sg s ON s.seq = us.seq AND s.t1 IS NOT NULL AND (us.tt >= s.t AND us.tt < s.t1 OR us.tt >= us.z AND s.t1 = us.z))"""


@query(f"WITH {OUTSIDE} SELECT seq, idx, round(e + (t - st) * (e1 - e) / (t1 - st), 3) + 0.0 AS e, round(n + (t - st) * (n1 - n) / (t1 - st), 3) + 0.0 AS n FROM pk")
def o2_interpolate_extrapolate(spark, d):
    return _outside(spark, d, "extrapolate")


@query(f"WITH {OUTSIDE} SELECT seq, idx, round(e + (least(greatest(t, a), z) - st) * (e1 - e) / (t1 - st), 3) + 0.0 AS e, round(n + (least(greatest(t, a), z) - st) * (n1 - n) / (t1 - st), 3) + 0.0 AS n FROM pk")
def o16_interpolate_clamp(spark, d):
    return _outside(spark, d, "clamp")


@query(f"""WITH {POSE}, st AS (SELECT *, coalesce(sqrt((e - lag(e) OVER w) ** 2 + (n - lag(n) OVER w) ** 2), 0) AS d FROM pose WINDOW w AS (PARTITION BY seq ORDER BY idx)),
ar AS (SELECT *, sum(d) OVER (PARTITION BY seq ORDER BY idx) AS s FROM st),
sg AS (SELECT *, lead(s) OVER w AS s1, lead(e) OVER w AS e1, lead(n) OVER w AS n1, lead(t) OVER w AS t1 FROM ar WINDOW w AS (PARTITION BY seq ORDER BY idx)),
k AS (SELECT seq, s0, e, n, t, s1, e1, n1, t1, k FROM (SELECT seq, s AS s0, e, n, t, s1, e1, n1, t1, unnest(range(ceil(s / 2.5)::BIGINT, CASE WHEN s1 IS NULL THEN floor(s / 2.5) + 1 ELSE ceil(s1 / 2.5) END::BIGINT)) AS k FROM sg))
SELECT seq, k::INT AS k, k * 2.5::DOUBLE AS s, round(CASE WHEN s1 IS NULL OR s1 = s0 THEN e ELSE e + (k * 2.5 - s0) * (e1 - e) / (s1 - s0) END, 3) + 0.0 AS e,
  round(CASE WHEN s1 IS NULL OR s1 = s0 THEN n ELSE n + (k * 2.5 - s0) * (n1 - n) / (s1 - s0) END, 3) + 0.0 AS n,
  round(CASE WHEN s1 IS NULL OR s1 = s0 THEN t ELSE t + (k * 2.5 - s0) * (t1 - t) / (s1 - s0) END, 1) AS t FROM k""")
def o3_resample_distance(spark, d):
    return _r(_r(trajectory.resample_by_distance(T.pose(spark, d), 2.5), 3, "e", "n"), 1, "t")


@query(f"WITH {MOTION} SELECT seq, idx, round(heading, 6) + 0.0 AS heading FROM hd")
def o4_headings(spark, d):
    return _r(trajectory.headings(T.pose(spark, d)).select("seq", "idx", "heading"), 6, "heading")


@query(f"WITH {MOTION} SELECT seq, idx, round(ang_vel * 1e6, 4) + 0.0 AS ang_vel FROM av")
def o5_angular_velocity(spark, d):
    return _motion(spark, d).select("seq", "idx", _scaled_round(F.col("ang_vel") * 1e6, 4).alias("ang_vel"))


@query(f"WITH {MOTION} SELECT seq, idx, round(speed * 1e3, 5) AS speed FROM mo")
def o6_speed(spark, d):
    return _motion(spark, d).select("seq", "idx", F.round(F.col("speed") * 1e3, 5).alias("speed"))


def slope_sql(value: str, source: str, name: str) -> str:
    s = lambda k, y="": f"list_sum(list_transform(l, lambda z: (z.u - t) ** {k}{y}))"
    return f"""{name}0 AS (SELECT *, list(struct_pack(u := t, y := {value})) OVER (PARTITION BY seq ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l FROM {source}),
{name}1 AS (SELECT *, len(l) AS c, {s(0)} AS s0, {s(1)} AS s1, {s(2)} AS s2, {s(3)} AS s3, {s(4)} AS s4, {s(0, ' * z.y')} AS y0, {s(1, ' * z.y')} AS y1, {s(2, ' * z.y')} AS y2 FROM {name}0),
{name}2 AS (SELECT * EXCLUDE (l, c, s0, s1, s2, s3, s4, y0, y1, y2), CASE WHEN c >= 3 THEN
  (s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) ELSE 0 END AS {name} FROM {name}1)"""


# hours keep the fourth powers small
HOURS = "mh AS (SELECT seq, idx, (t - min(t) OVER (PARTITION BY seq)) / 3600 AS t, speed * 3600 AS speed, ang_vel * 3600 AS ang_vel FROM mo)"


def _hours(spark, d):
    from pyspark.sql import Window as W

    m = _motion(spark, d)
    t = (F.col("t") - F.min("t").over(W.partitionBy("seq"))) / 3600
    m = m.select("seq", "idx", t.alias("t"), (F.col("speed") * 3600).alias("speed"), (F.col("ang_vel") * 3600).alias("ang_vel"))
    return trajectory.slopes(m, {"speed": "lin_acc", "ang_vel": "ang_acc"}, 10, singular=None)


KIN = f"{MOTION}, {HOURS}, {slope_sql('speed', 'mh', 'lin_acc')}, {slope_sql('ang_vel', 'lin_acc2', 'ang_acc')}"


@query(f"WITH {KIN} SELECT seq, idx, round(lin_acc, 3) + 0.0 AS lin_acc, round(ang_acc, 4) + 0.0 AS ang_acc FROM ang_acc2")
def o7_acceleration(spark, d):
    return _hours(spark, d).select("seq", "idx", _scaled_round(F.col("lin_acc"), 3).alias("lin_acc"), _scaled_round(F.col("ang_acc"), 4).alias("ang_acc"))


SIZE = f"""{KIN}, sz AS (SELECT *, CASE WHEN speed < 0.5 AND abs(ang_vel) < 0.05 THEN 20.0 ELSE greatest(1.0, least(20 - 19 * (
  0.5 * least(greatest(abs(ang_vel) / 0.5, 0), 1) + 0.2 * least(greatest(speed / 20.0, 0), 1) + 0.3 * least(greatest(abs(ang_acc) / 0.5, 0), 1) + 0.0 * least(greatest(abs(lin_acc) / 2.5, 0), 1)), 20.0)) END AS size FROM ang_acc2)"""


@query(f"WITH {SIZE} SELECT seq, idx, round(size, 3) AS size FROM sz")
def o8_adaptive_size(spark, d):
    return _r(trajectory.adaptive_size(_hours(spark, d)).select("seq", "idx", "size"), 3, "size")


@query(f"""WITH {KIN}, sz AS (SELECT *, CASE WHEN speed < 0.5 AND abs(ang_vel) < 0.05 THEN 20.0 ELSE greatest(1.0, least(round_even(20 * exp(-ln(20.0) * (
  0.5 * least(greatest(abs(ang_vel) / 0.5, 0), 1) + 0.2 * least(greatest(speed / 20.0, 0), 1) + 0.3 * least(greatest(abs(ang_acc) / 0.5, 0), 1))), 0), 20.0)) END AS size FROM ang_acc2)
SELECT seq, idx, size FROM sz""")
def o8_adaptive_size_exponential(spark, d):
    return trajectory.adaptive_size(_hours(spark, d), exponential=True).select("seq", "idx", "size")


@query(f"""WITH RECURSIVE {SIZE}, nn AS (SELECT seq, max(idx) AS m FROM sz GROUP BY seq),
nx AS (SELECT seq, idx, least(floor(idx + greatest(1.0, round(size, 3))), m)::INT AS nt FROM (SELECT sz.*, m FROM sz JOIN nn USING (seq)) WHERE idx < m),
c AS (SELECT seq, 0 AS idx, 0 AS k FROM nn UNION ALL SELECT c.seq, nx.nt, c.k + 1 FROM c JOIN nx ON nx.seq = c.seq AND nx.idx = c.idx),
tt AS (SELECT c.seq, k, mo.t FROM c JOIN mo ON mo.seq = c.seq AND mo.idx = c.idx)
SELECT seq, k::INT AS bin_id, round(t, 3) AS t0, round(t1, 3) AS t1 FROM (SELECT *, lead(t) OVER (PARTITION BY seq ORDER BY k) AS t1 FROM tt) WHERE t1 IS NOT NULL""")
def w4_adaptive_bins(spark, d):
    s = trajectory.adaptive_size(_hours(spark, d)).select("seq", "idx", F.round("size", 3).alias("size"))
    m = s.join(T.pose(spark, d).select("seq", "idx", "t"), ["seq", "idx"])
    return _r(binning.adaptive_bins(m), 3, "t0", "t1")


@query(f"""WITH {POSE}, h AS (SELECT a.seq, b.idx AS j, a.idx AS i, sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) AS d FROM pose a JOIN pose b ON a.seq = b.seq AND a.idx < b.idx - 20 AND b.idx >= 20)
SELECT seq, (arg_min(i, (j, d, i))) AS i, min(j) AS j FROM (SELECT *, min(j) OVER (PARTITION BY seq) AS mj FROM h WHERE d < 5) WHERE j = mj GROUP BY seq""")
def o9_first_self_loop(spark, d):
    return trajectory.first_self_loop(T.pose(spark, d), 5.0, 20)


@query(f"""WITH {POSE}, x AS (SELECT seq, sqrt((lead(e) OVER w - e) ** 2 + (lead(n) OVER w - n) ** 2) AS d FROM pose WINDOW w AS (PARTITION BY seq ORDER BY idx))
SELECT seq, count(*) AS num_frames, round(avg(d), 6) AS mean_displacement, round(stddev_pop(d), 6) AS std_displacement FROM x GROUP BY seq""")
def o10_displacement_stats(spark, d):
    return _r(trajectory.displacement_stats(T.pose(spark, d), "seq"), 6, "mean_displacement", "std_displacement")


HV = "sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2"


@query(f"""WITH {GEO}, x AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM geo WINDOW w AS (PARTITION BY seq ORDER BY idx)), h AS (SELECT *, {HV} AS a FROM x WHERE lat2 IS NOT NULL)
SELECT seq, idx, round(6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS d_atan, round(6371000.0 * 2 * asin(sqrt(a)), 3) AS d_asin FROM h""")
def o11_haversine(spark, d):
    g = _geo(spark, d).withColumn("lat2", F.lead("lat").over(trajectory.by())).withColumn("lon2", F.lead("lon").over(trajectory.by())).where("lat2 is not null")
    args = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return g.select("seq", "idx", F.round(trajectory.haversine(*args), 3).alias("d_atan"), F.round(trajectory.haversine(*args, arcsin=True), 3).alias("d_asin"))


@query(f"WITH {POSE} SELECT seq, idx, round((e * 37 - n * 11 + 180) - floor((e * 37 - n * 11 + 180) / 360) * 360 - 180, 4) + 0.0 AS diff FROM pose")
def o12_angle_diff(spark, d):
    return T.pose(spark, d).select("seq", "idx", (F.round(trajectory.angle_diff(F.col("e") * 37, F.col("n") * 11), 4) + 0.0).alias("diff"))


@query(f"""WITH RECURSIVE {POSE}, p AS (SELECT seq, idx, e, n FROM pose),
c AS (SELECT seq, 0 AS ord, idx, e, n, [idx] AS seen FROM p WHERE idx = 0 UNION ALL
  SELECT seq, ord, idx, e, n, seen FROM (SELECT c.seq, c.ord + 1 AS ord, p.idx, p.e, p.n, list_append(c.seen, p.idx) AS seen,
    row_number() OVER (PARTITION BY c.seq ORDER BY sqrt((p.e - c.e) ** 2 + (p.n - c.n) ** 2), p.idx) AS rn FROM c JOIN p ON p.seq = c.seq AND NOT list_contains(c.seen, p.idx)) WHERE rn = 1)
SELECT seq, ord::INT AS ord, idx FROM c""")
def o13_greedy_tour(spark, d):
    return trajectory.greedy_tour(T.pose(spark, d))


@query(f"WITH {POSE} SELECT seq, idx FROM pose WHERE e > -20 AND e < 20 AND n > -30 AND n < 30")
def o14_bounding_box(spark, d):
    return trajectory.in_box(T.pose(spark, d), (-20, 20), (-30, 30)).select("seq", "idx")


@query(f"""WITH {POSE}, h AS (SELECT DISTINCT a.seq AS a, b.seq AS b, b.idx FROM pose a JOIN pose b ON a.seq < b.seq AND sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) < 2)
SELECT a, b, count(*) AS overlap FROM h GROUP BY a, b ORDER BY overlap DESC, a, b LIMIT 1""")
def o15_most_overlapping(spark, d):
    return trajectory.most_overlapping(T.pose(spark, d), 2.0)


@query(f"""WITH {POSE}, d AS (SELECT *, sqrt((lead(e) OVER w - e) ** 2 + (lead(n) OVER w - n) ** 2) AS d FROM pose WINDOW w AS (PARTITION BY seq ORDER BY idx))
SELECT seq, coalesce(min(idx) FILTER (d >= 6), 0)::INT AS start_idx FROM d GROUP BY seq""")
def w15_crop_start(spark, d):
    return binning.crop_start(T.pose(spark, d), 6.0)


@query(f"""WITH {POSE}, p AS (SELECT seq, idx, round(e) AS e, round(n) AS n FROM pose), d AS (SELECT *, sqrt((lead(e) OVER w - e) ** 2 + (lead(n) OVER w - n) ** 2) AS d FROM p WINDOW w AS (PARTITION BY seq ORDER BY idx))
SELECT seq, coalesce(min(idx) FILTER (d > 5), 0)::INT AS start_idx FROM d GROUP BY seq""")
def w15_crop_start_strict(spark, d):
    """On whole metres, where a step of exactly the bound occurs."""
    p = T.pose(spark, d).select("seq", "idx", F.round("e").alias("e"), F.round("n").alias("n"))
    return binning.crop_start(p, 5.0, strict=True)


NEAR = f"""{POSE}, {GRID}, bk AS (SELECT g.seq, g.idx, g.t, p.t AS bt, p.idx AS bi FROM g ASOF LEFT JOIN pose p ON g.seq = p.seq AND g.t >= p.t),
nr AS (SELECT bk.*, p.t AS ft, p.idx AS fi FROM bk ASOF LEFT JOIN pose p ON bk.seq = p.seq AND bk.t <= p.t)"""


@query(f"WITH {NEAR} SELECT seq, idx, CASE WHEN ft IS NULL OR bt IS NOT NULL AND t - bt < ft - t THEN bi ELSE fi END AS near_row FROM nr")
def j4_nearest_time(spark, d):
    track = T.pose(spark, d)
    g = trajectory.uniform_grid(track, 7200.0)
    near = joins.nearest_time(g, track.withColumnRenamed("idx", "row"), "seq", "t", ["row"], DAY)
    return near.select("seq", "idx", "near_row")


@query(f"WITH {NEAR} SELECT seq, idx, round(CASE WHEN ft IS NULL OR bt IS NOT NULL AND t - bt < ft - t THEN bt ELSE ft END, 3) AS near_t FROM nr")
def w16_nearest_resample(spark, d):
    track = T.pose(spark, d)
    g = trajectory.uniform_grid(track, 7200.0)
    return joins.nearest_time(g, track.select("seq", "t"), "seq", "t", [], DAY).select("seq", "idx", F.round("near_t", 3).alias("near_t"))


@query(f"WITH {NEAR} SELECT seq, idx, bi AS prev_row, fi AS next_row FROM nr")
def j3_asof(spark, d):
    track = T.pose(spark, d).withColumnRenamed("idx", "row")
    g = trajectory.uniform_grid(track, 7200.0)
    back = joins.asof(g, track, "seq", "t", ["row"], DAY)
    both = joins.asof(back, track, "seq", "t", ["row"], DAY, "forward", "next_")
    return both.select("seq", "idx", "prev_row", "next_row")


@query(f"WITH {POSE} SELECT seq, round(min(t) FILTER (t >= 1.7041e9), 3) AS first_ge, round(max(t) FILTER (t <= 1.7041e9), 3) AS last_le FROM pose GROUP BY seq")
def j3b_asof_values(spark, d):
    t = F.col("t")
    return T.pose(spark, d).groupBy("seq").agg(F.round(F.min(F.when(t >= 1.7041e9, t)), 3).alias("first_ge"), F.round(F.max(F.when(t <= 1.7041e9, t)), 3).alias("last_le"))


PLACES = DESC + ", qp AS (SELECT idx AS q, 10.0 * idx AS qe, 10.0 * label AS qn FROM qs), rp AS (SELECT idx AS r, 10.0 * (idx // 4) AS re, 10.0 * label AS rn FROM rs)"


def _places(spark, d):
    q, r = T.descriptors(spark, d)
    a = q.select(F.col("idx").alias("q"), (F.col("idx") * 10.0).alias("qe"), (F.col("label") * 10.0).alias("qn"))
    b = r.select(F.col("idx").alias("r"), (F.floor(F.col("idx") / 4) * 10.0).alias("re"), (F.col("label") * 10.0).alias("rn"))
    return a, b


@query(f"WITH {PLACES} SELECT q, r FROM qp JOIN rp ON sqrt((qe - re) ** 2 + (qn - rn) ** 2) <= 20")
def j1_radius_join(spark, d):
    return joins.radius_join(*_places(spark, d), 20.0).select("q", "r")


@query(f"WITH {PLACES} SELECT q, r FROM qp JOIN rp ON sqrt((qe - re) ** 2 + (qn - rn) ** 2) < 20")
def j1b_radius_join_strict(spark, d):
    return joins.radius_join(*_places(spark, d), 20.0, inclusive=False).select("q", "r")


@query(f"WITH {POSE} SELECT a.seq, a.idx AS i, b.idx AS j FROM pose a JOIN pose b ON a.seq = b.seq AND a.idx < b.idx - 20 AND sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) < 3")
def j2_self_spatial_join(spark, d):
    p = T.pose(spark, d)
    a = p.select(F.struct("seq", "idx").alias("q"), F.col("e").alias("qe"), F.col("n").alias("qn"))
    b = p.select(F.struct("seq", "idx").alias("r"), F.col("e").alias("re"), F.col("n").alias("rn"))
    hit = joins.radius_join(a, b, 3.0, inclusive=False).where("q.seq = r.seq and q.idx < r.idx - 20")
    return hit.select(F.col("q.seq").alias("seq"), F.col("q.idx").alias("i"), F.col("r.idx").alias("j"))


@query(f"WITH {PLACES} SELECT q, (arg_min(r, (d, r))) AS r, round(min(d), 4) AS dist FROM (SELECT q, r, sqrt((qe - re) ** 2 + (qn - rn) ** 2) AS d FROM qp, rp) GROUP BY q")
def j5_nearest_place(spark, d):
    return _r(joins.nearest_place(*_places(spark, d)), 4, "dist")


@query(f"""WITH {EV}, k AS (SELECT seq, min(t) + 100000 AS a, min(t) + 400000 AS z FROM ev GROUP BY seq)
SELECT ev.seq, count(*) AS n FROM ev JOIN k ON ev.seq = k.seq AND t BETWEEN a AND z GROUP BY ev.seq""")
def s3_crop_to_range(spark, d):
    from ..sources import readers

    ev = T.events(spark, d)
    ends = ev.groupBy("seq").agg(F.min("t").alias("m")).select("seq", F.explode(F.array(F.col("m") + 100000, F.col("m") + 400000)).alias("t"))
    return readers.crop_to(ev, ends).groupBy("seq").agg(F.count("*").alias("n"))
