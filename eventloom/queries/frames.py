"""Filters and features of whole frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..operators import inference, stencils
from ..sources import frames as sink
from ..sources import videos
from ..sources import tables as T
from . import query
from .matching import PIX, _pixels, _r

H, W = T.HEIGHT, T.WIDTH

#: every pixel of the count images; 127 where nothing happened
DENSE = f"""{PIX},
de AS (SELECT f.seq, f.bin_id, y, x, coalesce(px.v, 127)::DOUBLE AS v FROM (SELECT DISTINCT seq, bin_id FROM px) f CROSS JOIN (SELECT unnest(range({H}))::INT AS y) CROSS JOIN (SELECT unnest(range({W}))::INT AS x) LEFT JOIN px USING (seq, bin_id, y, x))"""


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + ")"


def _mirror(c: str, size: int) -> str:
    return f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {size - 1} THEN {2 * size - 2} - ({c}) ELSE {c} END"


G = stencils.gaussian(5, 1.0)


@query(f"""WITH {DENSE}, k AS (SELECT * FROM {_values([(dy - 2, dx - 2, G[dy] * G[dx]) for dy in range(5) for dx in range(5)])} t(dy, dx, w))
SELECT a.seq, a.bin_id, a.y, a.x, round(1.3::DOUBLE * any_value(a.v) - 0.3::DOUBLE * sum(w * b.v), 4) + 0.0 AS v
FROM de a CROSS JOIN k JOIN de b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""")
def a12_unsharp(spark, d):
    px = _pixels(spark, d)
    return _r(stencils.unsharp(px, ["seq", "bin_id"], H, W, 0.3, 1.0, fill=127.0), 4, "v")


@query(f"""WITH {DENSE}, k AS (SELECT * FROM {_values([(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4])} t(dy, dx)),
n AS (SELECT a.seq, a.bin_id, a.y, a.x, exp(-(dy * dy + dx * dx) / 1250.0::DOUBLE) * exp(-((b.v - a.v) ** 2) / 1250.0::DOUBLE) AS w, b.v
  FROM de a CROSS JOIN k JOIN de b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = {_mirror("a.y + dy", H)} AND b.x = {_mirror("a.x + dx", W)})
SELECT seq, bin_id, y, x, round(sum(w * v) / sum(w), 4) + 0.0 AS v FROM n GROUP BY ALL""")
def a12_bilateral(spark, d):
    px = _pixels(spark, d)
    return _r(stencils.bilateral(px, ["seq", "bin_id"], H, W, 1.0, fill=127.0), 4, "v")


_RING = [(k, dy, dx) for k, (dy, dx) in enumerate(stencils.CIRCLE)]
_SOBEL = [(dy, dx, (1, 2, 1)[dy + 1] * dx, (1, 2, 1)[dx + 1] * dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query(f"""WITH {DENSE}, nb AS (SELECT seq, bin_id, y, x, floor(v / max(v) OVER (PARTITION BY seq, bin_id) * 255) AS v FROM de),
g AS (SELECT a.seq, a.bin_id, a.y, a.x, any_value(a.v) AS v, sum(kx * b.v) AS gx, sum(ky * b.v) AS gy FROM nb a CROSS JOIN {_values(_SOBEL)} k(dy, dx, kx, ky)
  JOIN nb b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = {_mirror("a.y + dy", H)} AND b.x = {_mirror("a.x + dx", W)} GROUP BY ALL),
o AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, CASE WHEN gy > 0 THEN CASE WHEN gx > gy THEN 4 WHEN gx > 0 THEN 5 WHEN gy > -gx THEN 6 ELSE 7 END
  WHEN gy < 0 THEN CASE WHEN gx < 0 THEN CASE WHEN gy > gx THEN 0 ELSE 1 END WHEN -gy > gx THEN 2 ELSE 3 END WHEN gx < 0 THEN 7 ELSE 4 END AS o FROM g),
t AS (SELECT seq, bin_id, avg((m > 10)::INT) AS density, avg(m) AS mean, max(m) AS most, list_transform(range(8), lambda k: len(list_filter(list(o), lambda x: x = k)) / count(*)) AS h FROM o GROUP BY ALL),
hs AS (SELECT a.seq, a.bin_id, a.y, a.x, sum(b.gx * b.gx) / 64 AS a, sum(b.gx * b.gy) / 64 AS b, sum(b.gy * b.gy) / 64 AS c FROM g a CROSS JOIN {_values([(0, 0), (0, -1), (-1, 0), (-1, -1)])} k(dy, dx)
  JOIN g b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = {_mirror("a.y + dy", H)} AND b.x = {_mirror("a.x + dx", W)} GROUP BY ALL),
hr AS (SELECT seq, bin_id, avg(a * c - b * b - 0.04::DOUBLE * (a + c) ** 2) AS hmean, max(a * c - b * b - 0.04::DOUBLE * (a + c) ** 2) AS hmax FROM hs GROUP BY ALL),
rg AS (SELECT a.seq, a.bin_id, a.y, a.x, list(b.v - a.v ORDER BY k) AS l FROM nb a CROSS JOIN {_values(_RING)} k(k, dy, dx) JOIN nb b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = a.y + dy AND b.x = a.x + dx
  WHERE a.y BETWEEN 3 AND {H - 4} AND a.x BETWEEN 3 AND {W - 4} GROUP BY ALL),
sc AS (SELECT seq, bin_id, y, x, greatest(list_max(list_transform(range(1, 17), lambda k: list_min((l || l[:8])[k:k + 8]))), list_max(list_transform(range(1, 17), lambda k: -list_max((l || l[:8])[k:k + 8])))) AS s FROM rg),
kp AS (SELECT a.seq, a.bin_id, count(*) AS fast FROM sc a WHERE s > 10 AND NOT EXISTS (SELECT 1 FROM sc b WHERE b.seq = a.seq AND b.bin_id = a.bin_id AND b.s > 10 AND b.s >= a.s AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y, b.x) <> (a.y, a.x)) GROUP BY ALL)
SELECT seq, bin_id, round(density, 5) + 0.0 AS sobel_edge_density, round(mean, 4) + 0.0 AS sobel_grad_magnitude_mean, round(CASE WHEN most > 0 THEN list_max(h) - list_min(h) ELSE 0 END, 5) + 0.0 AS sobel_directional_bias,
  round(hmean, 1) + 0.0 AS harris_response_mean, round(hmax, 1) + 0.0 AS harris_response_max, coalesce(fast, 0) AS fast_keypoint_count
FROM t JOIN hr USING (seq, bin_id) LEFT JOIN kp USING (seq, bin_id)""")
def d14x_edge_features(spark, d):
    f = stencils.edge_features(_pixels(spark, d), ["seq", "bin_id"], H, W, fill=127.0)
    f = _r(_r(f, 5, "sobel_edge_density", "sobel_directional_bias"), 4, "sobel_grad_magnitude_mean")
    return _r(f, 1, "harris_response_mean", "harris_response_max")


# ------------------------------------------------------------ video, models
def _frames(spark, d):
    """(seq, bin_id, height, width, pixels): the count images as whole frames."""
    return sink.dense(_pixels(spark, d), ["seq", "bin_id"], F.lit(""), H, W, fill=127).select("seq", "bin_id", "height", "width", "pixels")


def _total(pixels):
    values = F.transform(F.sequence(F.lit(1), F.length(pixels)), lambda k: F.conv(F.hex(F.substring(pixels, k, 1)), 16, 10).cast("int"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


NUMBERED = f"{DENSE}, fr AS (SELECT seq, bin_id, row_number() OVER (PARTITION BY seq ORDER BY bin_id) - 1 AS frame FROM (SELECT DISTINCT seq, bin_id FROM de))"


@query(f"WITH {NUMBERED} SELECT seq, frame, round(frame / 30, 6) AS t, sum(v)::BIGINT AS total FROM de JOIN fr USING (seq, bin_id) WHERE y < {H - 2} AND frame % 3 = 0 AND frame < 60 GROUP BY ALL")
def s12_k2_video(spark, d):
    """A video for each sequence, of which every third frame before the 60th is read, without its last two rows."""
    videos.register(spark)
    folder, out = session.fresh_dir(spark, "videos"), None
    f = _frames(spark, d)
    for s in ("s0", "s1", "s2"):
        f.where(F.col("seq") == s).sort("bin_id").coalesce(1).write.format("y4m").mode("append").option("rate", 30).save(f"{folder}/{s}")
        back = spark.read.format("y4m").option("every", 3).option("crop", 2).option("rows", 4).load(f"{folder}/{s}").where("frame < 60").withColumn("seq", F.lit(s))
        out = back if out is None else out.unionByName(back)
    return out.select("seq", "frame", F.round("t", 6).alias("t"), _total("pixels").alias("total"))


_KERNELS = [[[1, 1, 1], [1, 1, 1], [1, 1, 1]], [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]]
_CELLS = [(c, a - 1, b - 1, k[a][b]) for c, k in enumerate(_KERNELS) for a in range(3) for b in range(3)]


@query(f"""WITH {DENSE}, cv AS (SELECT a.seq, a.bin_id, a.y, a.x, c, greatest(sum(w * b.v / 255.0::DOUBLE), 0) AS v FROM de a CROSS JOIN {_values(_CELLS)} k(c, dy, dx, w)
  JOIN de b ON b.seq = a.seq AND b.bin_id = a.bin_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
m AS (SELECT seq, bin_id, ((y // {H // 2} * 2 + x // {W // 2}) * 4 + c)::INT AS k, avg(v) AS v FROM cv GROUP BY ALL)
SELECT seq, bin_id, k, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY seq, bin_id)), 1e-8), 6) + 0.0 AS v FROM m""")
def d2_model_descriptors(spark, d):
    """A small network of fixed weights, loaded once in each worker."""
    out = inference.describe(_frames(spark, d), inference.tiny_describer, "tiny")
    return _r(out.select("seq", "bin_id", F.posexplode("vec").alias("k", "v")), 6, "v")


@query(f"""WITH RECURSIVE {NUMBERED}, mn AS (SELECT a.seq, a.bin_id, a.y, a.x, sum(b.v) / 9 AS m FROM de a JOIN de b ON b.seq = a.seq AND b.bin_id = a.bin_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL),
im AS (SELECT seq, y, x, frame, m FROM mn JOIN fr USING (seq, bin_id)),
st AS (SELECT seq, y, x, frame, m AS s FROM im WHERE frame = 0 UNION ALL SELECT im.seq, im.y, im.x, im.frame, 0.75::DOUBLE * st.s + 0.25::DOUBLE * im.m FROM st JOIN im ON im.seq = st.seq AND im.y = st.y AND im.x = st.x AND im.frame = st.frame + 1)
SELECT seq, bin_id, sum(floor(s + 1e-6))::BIGINT AS total FROM st JOIN fr USING (seq, frame) GROUP BY ALL""")
def a10_model_frames(spark, d):
    """A recurrent unit over the frames of each sequence in order."""
    out = inference.reconstruct(_frames(spark, d), "seq", ["bin_id"], inference.tiny_reconstructor, "unit")
    return out.select("seq", "bin_id", _total("out").alias("total"))
