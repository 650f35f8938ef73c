"""The table adapters as SQL, for the checks."""

DELTA = 21600.0  # seconds in a bin
TAU = 3600.0

EV = """ev AS (SELECT 's' || (user_id % 3) AS seq, event_id, epoch_us(ts) / 1e6 AS t, (user_id % 16)::INT AS x, (event_id % 12)::INT AS y,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS p FROM events),
b AS (SELECT seq, min(t) AS t_first, max(t) AS t_last FROM ev GROUP BY seq),
bins AS (SELECT seq, i::INT AS bin_id, t_first + i * 21600.0::DOUBLE AS t0, t_first + (i + 1) * 21600.0::DOUBLE AS t1
  FROM (SELECT seq, t_first, unnest(range(greatest(ceil((t_last - 21600.0::DOUBLE - t_first) / 21600.0::DOUBLE), 0)::BIGINT)) AS i FROM b)),
be AS (SELECT ev.*, bin_id FROM ev JOIN bins ON ev.seq = bins.seq AND ev.t BETWEEN t0 AND t1)"""

POSE = """pose AS (SELECT seq, idx, t, se / 1000 AS e, sn / 10 AS n FROM (
  SELECT 'u' || (user_id % 8) AS seq, epoch_us(ts) / 1e6 AS t, (row_number() OVER w - 1)::INT AS idx,
    sum(round(value * 100) - 5000) OVER w AS se, sum(round((props ->> '$.k')::DOUBLE) - 50) OVER w AS sn
  FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts, event_id)))"""

MOTION = POSE + """,
st AS (SELECT *, e - lag(e) OVER w AS de, n - lag(n) OVER w AS dn, t - lag(t) OVER w AS dt FROM pose WINDOW w AS (PARTITION BY seq ORDER BY idx)),
hd AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY seq ORDER BY idx ROWS UNBOUNDED PRECEDING),
    first_value(h IGNORE NULLS) OVER (PARTITION BY seq ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS heading
  FROM (SELECT *, CASE WHEN sqrt(de * de + dn * dn) >= 1e-3 THEN atan2(dn, de) END AS h FROM st)),
dh AS (SELECT *, heading - lag(heading) OVER (PARTITION BY seq ORDER BY idx) AS d FROM hd),
uw AS (SELECT *, sum(coalesce(CASE WHEN abs(w - -pi()) < 1e-15 AND d > 0 THEN pi() ELSE w END, heading)) OVER (PARTITION BY seq ORDER BY idx) AS u
  FROM (SELECT *, (d + pi()) - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS w FROM dh)),
av AS (SELECT *, CASE WHEN idx >= 11 THEN least(greatest((u - lag(u, 10) OVER w) / (t - lag(t, 10) OVER w), -pi() / 6), pi() / 6) ELSE 0 END AS ang_vel
  FROM uw WINDOW w AS (PARTITION BY seq ORDER BY idx)),
mo AS (SELECT *, coalesce(v, lead(v) OVER (PARTITION BY seq ORDER BY idx)) AS speed
  FROM (SELECT *, sqrt(de * de + dn * dn) / greatest(dt, 1e-6) AS v FROM av))"""

DESC = """num AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec, vec_id % 5 = 0 AS isq FROM embeddings),
qs AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS idx, vec, label FROM num WHERE isq),
rs AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS idx, vec, label FROM num WHERE NOT isq),
pos AS (SELECT q.idx AS q, r.idx AS r FROM qs q JOIN rs r USING (label))"""

L2 = "-list_sum(list_transform(list_zip(q.vec, r.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
SAD = "-list_sum(list_transform(list_zip(q.vec, r.vec), lambda z: abs(z[1] - z[2])))"
COS = "list_dot_product(q.vec, r.vec) / (sqrt(list_dot_product(q.vec, q.vec)) + 1e-8) / (sqrt(list_dot_product(r.vec, r.vec)) + 1e-8)"

#: three runs of scores of all queries and references
SIM = DESC + f""",
sim AS (
  SELECT 'l2' AS run, q.idx AS q, r.idx AS r, round({L2}, 6) AS s FROM qs q, rs r UNION ALL
  SELECT 'cosine', q.idx, r.idx, round({COS}, 6) FROM qs q, rs r UNION ALL
  SELECT 'sad', q.idx, r.idx, round({SAD}, 6) FROM qs q, rs r)"""


def modified(length: int, guard: bool, source: str = "sim") -> str:
    """Sequence matching as SQL: CTE ``ms`` (run, q, r, s)."""
    sd = f"CASE WHEN stddev_pop(s) OVER w + 1e-8 < 1e-4 THEN 1.0 ELSE stddev_pop(s) OVER w + 1e-8 END" if guard else "stddev_pop(s) OVER w + 1e-8"
    return f"""ms0 AS (SELECT run, q, r, avg(s) OVER w AS m, {sd} AS sd FROM {source} WINDOW w AS (PARTITION BY run, r ORDER BY q ROWS {length - 1} PRECEDING)),
ms1 AS (SELECT a.run, b.q, a.q AS i, a.r, (a.s - b.m) / b.sd AS c FROM {source} a JOIN ms0 b ON a.run = b.run AND a.r = b.r AND b.q BETWEEN a.q AND a.q + {length - 1}),
ms2 AS (SELECT *, (c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-8) AS z, max(r) OVER w AS top FROM ms1 WINDOW w AS (PARTITION BY run, q, i)),
ms AS (SELECT run, q, r + q - i AS r, sum(z) AS s FROM ms2 WHERE r + q - i <= top GROUP BY ALL)"""
