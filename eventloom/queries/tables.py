"""Sources, sinks, configuration and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..operators import binning, joins, similarity, trajectory
from ..operators import scored as S
from ..sources import models, readers
from ..sources import tables as T
from ..streaming import windows
from . import query
from .ctes import DESC, EV, POSE, SIM
from .reports import RES, results


@query(f"WITH {EV} SELECT seq, coalesce(CASE WHEN event_id % 10 = 0 THEN NULL ELSE p END, 0)::INT AS p, count(*) AS n, sum(x)::BIGINT AS xs FROM ev GROUP BY ALL")
def s1_event_scan(spark, d):
    folder = session.fresh_dir(spark, "events")
    T.events(spark, d).withColumn("p", F.when(F.col("event_id") % 10 != 0, F.col("p"))).withColumn("other", F.lit("unread")).write.partitionBy("seq").parquet(folder)
    out = None
    for s in ("s0", "s1", "s2"):
        one = readers.event_table(spark, f"{folder}/seq={s}", s)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("seq", "p").agg(F.count("*").alias("n"), F.sum("x").alias("xs"))


@query(f"""WITH {EV}, k AS (SELECT seq, event_id, row_number() OVER (PARTITION BY seq ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY seq) AS n FROM ev)
SELECT seq, event_id FROM k WHERE k < floor(n * 0.2)""")
def s2_prefix_fraction(spark, d):
    raw = T.events(spark, d).withColumn("ts_ns", F.rint(F.col("t") * 1e6).cast("long") * 1000).drop("t")
    return readers.events_from_ns(raw, 0.2).select("seq", "event_id")


@query(f"WITH {POSE} SELECT seq, count(*) AS n, round(min(n / 10 - 30), 4) + 0.0 AS lat, round(max(t) + 5, 2) AS t FROM pose GROUP BY seq")
def s4_gps_text(spark, d):
    folder, out = session.fresh_dir(spark, "gps"), None
    T.pose(spark, d).select("seq", F.round(F.col("n") / 10 - 30, 6).alias("lat"), (F.col("e") / 10 + 150).alias("lon"), F.col("t").cast("decimal(20,6)")).write.partitionBy("seq").csv(folder, sep=" ")
    for k in range(8):
        one = readers.gps_text(spark, f"{folder}/seq=u{k}", f"u{k}", 5.0)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("seq").agg(F.count("*").alias("n"), (F.round(F.min("lat"), 4) + 0.0).alias("lat"), F.round(F.max("t"), 2).alias("t"))


@query("SELECT event_id, epoch_us(ts) AS t_us FROM events")
def s7_composite_timestamp(spark, d):
    e = T.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), (F.unix_micros(ts) % 1000000).cast("string"))
    return e.select("event_id", readers.composite_micros(text).alias("t_us"))


@query(f"WITH {POSE} SELECT round(n / 100, 6) + 0.0 AS lat, round(e / 100, 6) + 0.0 AS lon, (idx * 7 % 360)::DOUBLE AS heading, round(t * 1e6)::BIGINT AS t_us FROM pose")
def s7_gps_csv(spark, d):
    folder = session.fresh_dir(spark, "gps-csv")
    p = T.pose(spark, d)
    us = F.round(F.col("t") * 1e6).cast("long")
    stamp = F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), (us % 1000000).cast("string"))
    cols = [F.round(F.col("n") / 100, 6).alias("Latitude"), F.round(F.col("e") / 100, 6).alias("Longitude"), (F.col("idx") * 7 % 360).cast("double").alias("HeadMotion"), stamp.alias("Timestamp")]
    p.select(*cols).write.csv(folder, header=True)
    g = readers.gps_csv(spark, folder)
    return g.select((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"), "heading", "t_us")


@query("SELECT n_nationkey AS idx, round(n_nationkey * 1.5, 6) + 0.0 AS east, round(-n_regionkey * 2.25, 6) + 0.0 AS north FROM nation")
def s10_image_folder(spark, d):
    """An image per nation in a folder per region, between files of other kinds."""
    folder = session.fresh_dir(spark, "images")
    n = T.table(spark, d, "nation").select("n_nationkey", "n_regionkey")

    def run(pdf):
        from pyarrow import fs

        for key, region in zip(pdf["n_nationkey"], pdf["n_regionkey"]):
            system, path = fs.FileSystem.from_uri(f"{folder}/r{region}")
            system.create_dir(path, recursive=True)
            for name in (f"@{key * 1.5:.6f}@{region * -2.25:.6f}@frame_{key}@.{'JPG' if key % 2 else 'png'}", f"{key}.txt"):
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(b"image")
        return pdf

    n.groupBy("n_regionkey").applyInPandas(run, n.schema).count()
    return readers.frame_files(spark, folder).select("idx", (F.col("east") + 0.0).alias("east"), (F.col("north") + 0.0).alias("north"))


@query(f"""WITH {POSE}, g AS (SELECT seq, i::INT AS idx, a + i * 7200 AS t FROM (SELECT seq, min(t) AS a, max(t) AS z FROM pose GROUP BY seq), unnest(range(floor((z - a) / 7200)::BIGINT + 1)) AS u(i)),
c AS (SELECT g.seq, g.idx, p.idx AS frame, abs(p.t - g.t) AS d, p.t AS ft FROM g JOIN pose p ON p.seq = g.seq)
SELECT seq, idx, '/video/' || seq || '/frame_' || lpad(arg_min(frame, (d, ft))::VARCHAR, 6, '0') || '.png' AS path FROM c GROUP BY seq, idx""")
def s19_camera_paths(spark, d):
    p = T.pose(spark, d)
    ends = p.groupBy("seq").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    grid = ends.select("seq", "a", F.explode(F.sequence(F.lit(0), F.floor((F.col("z") - F.col("a")) / 7200).cast("int"))).alias("idx")).select("seq", "idx", (F.col("a") + F.col("idx") * 7200).alias("t"))
    return readers.camera_paths(grid, p, "/video", 7200.0)


@query("SELECT count(*) AS n, sum(x)::BIGINT AS xs, 16 AS width, 12 AS height FROM (SELECT (user_id % 16)::INT AS x FROM events)")
def s8_event_text(spark, d):
    folder = session.fresh_dir(spark, "event-text")
    lines = T.events(spark, d).select(F.concat_ws(" ", F.format_string("%.6f", "t"), "x", "y", "p").alias("value"))
    spark.createDataFrame([("16 12",)], "value string").unionByName(lines).write.text(folder)
    size = readers.event_text_size(spark, folder)
    return readers.event_text(spark, folder, "s1").agg(F.count("*").alias("n"), F.sum("x").alias("xs")).crossJoin(size)


def _nmea_lines(spark, d):
    """Sentences of a track, one kind in five of no use, one in seven with a zero; a
    sequence of more than the 1260 minutes from 3 to 24 h goes on as another one."""
    day = F.floor(F.col("idx") / 1260).cast("string")
    p = T.pose(spark, d).withColumn("seq", F.when(F.col("idx") >= 1260, F.concat_ws("/", "seq", day)).otherwise(F.col("seq")))
    deg = lambda c, digits: F.concat(F.format_string(f"%0{digits}d", F.floor(F.abs(c)).cast("int")), F.format_string("%09.6f", (F.abs(c) - F.floor(F.abs(c))) * 60))
    lat, lon = -27.4 + F.round(F.col("n"), 1) / 100000, 152.9 + F.round(F.col("e"), 1) / 100000
    lat = F.when(F.col("idx") % 7 == 3, 0.0).otherwise(lat)
    hms = F.format_string("%02d%02d%05.2f", (F.col("idx") % 1260 / 60).cast("int") + 3, F.col("idx") % 60, F.lit(12.5))
    gga = F.concat_ws(",", F.lit("$GPGGA"), hms, deg(lat, 2), F.when(lat < 0, "S").otherwise("N"), deg(lon, 3), F.lit("E"), F.lit("1"))
    rmc = F.concat_ws(",", F.lit("$GPRMC"), hms, F.lit("A"), deg(lat, 2), F.when(lat < 0, "S").otherwise("N"), deg(lon, 3), F.lit("E"))
    other = F.concat_ws(",", F.lit("$GPGSV"), hms)
    folder = session.fresh_dir(spark, "nmea")
    p.select("seq", "idx", F.when(F.col("idx") % 5 == 4, other).when(F.col("idx") % 2 == 0, gga).otherwise(rmc).alias("value")).write.csv(folder, sep="|")
    return spark.read.csv(folder, sep="|", schema="seq string, idx int, value string")


@query(f"""WITH {POSE} SELECT CASE WHEN idx >= 1260 THEN seq || '/' || (idx // 1260) ELSE seq END AS seq, idx, round(CASE WHEN idx % 7 = 3 THEN 0 ELSE -27.4::DOUBLE + round(n, 1) / 100000 END, 6) + 0.0 AS lat, round(152.9::DOUBLE + round(e, 1) / 100000, 6) AS lon, 60.0 * (idx % 1260) AS seconds
FROM pose WHERE idx % 5 <> 4""")
def s6_nmea_parse(spark, d):
    n = readers.nmea(_nmea_lines(spark, d))
    return n.select("seq", "idx", (F.round("lat", 6) + 0.0).alias("lat"), F.round("lon", 6).alias("lon"), F.round("seconds", 2).alias("seconds"))


@query(f"""WITH RECURSIVE {POSE}, pts AS (SELECT CASE WHEN idx >= 1260 THEN seq || '/' || (idx // 1260) ELSE seq END AS seq, idx, round(CASE WHEN idx % 7 = 3 THEN 0 ELSE -27.4::DOUBLE + round(n, 1) / 100000 END, 6) AS lat,
  round(152.9::DOUBLE + round(e, 1) / 100000, 6) AS lon FROM pose WHERE idx % 5 <> 4),
nm AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY idx) AS k FROM pts),
st AS (SELECT DISTINCT seq, 0::BIGINT AS k, -1 AS idx, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon, false AS took, false AS started FROM nm UNION ALL
  SELECT seq, k, idx, CASE WHEN ok THEN lat ELSE la END, CASE WHEN ok THEN lon ELSE lo END, ok, started OR ok FROM (
    SELECT nm.seq, nm.k, nm.idx, nm.lat, nm.lon, st.lat AS la, st.lon AS lo, started, nm.lat <> 0 AND nm.lon <> 0 AND nm.lat <> st.lat AND nm.lon <> st.lon AND (NOT started OR
      2 * 6371000.0::DOUBLE * asin(sqrt(sin((radians(nm.lat) - radians(st.lat)) / 2) ** 2 + cos(radians(st.lat)) * cos(radians(nm.lat)) * sin(radians(nm.lon - st.lon) / 2) ** 2)) > 1) AS ok
    FROM st JOIN nm ON nm.seq = st.seq AND nm.k = st.k + 1))
SELECT seq, idx FROM st WHERE took""")
def s6_nmea_thinned(spark, d):
    return trajectory.nmea_filter(readers.nmea(_nmea_lines(spark, d)), 1.0).select("seq", "idx")


@query(f"WITH {POSE} SELECT seq, CASE WHEN idx % 9 <> 5 THEN idx ELSE -1 END AS idx, round(e, 6) + 0.0 AS east, round(n, 6) + 0.0 AS north FROM pose")
def s11_frame_names(spark, d):
    p = T.pose(spark, d)
    tail = F.when(F.col("idx") % 9 != 5, F.concat(F.lit("@frame_"), F.col("idx").cast("string"), F.lit("@.jpg"))).otherwise("@other@.jpg")
    name = F.concat(F.lit("/data/"), F.col("seq"), F.lit("/@"), F.format_string("%.6f", "e"), F.lit("@"), F.format_string("%.6f", "n"), tail)
    return readers.frame_name(p.select("seq", name.alias("path")), "path").select("seq", F.coalesce("idx", F.lit(-1)).alias("idx"), (F.round("east", 6) + 0.0).alias("east"), (F.round("north", 6) + 0.0).alias("north"))


@query(f"WITH {POSE} SELECT seq, idx, CASE WHEN idx % 6 <> 1 THEN round(e, 4) + 0.0 END AS east, CASE WHEN idx % 6 <> 1 THEN round(n, 4) + 0.0 END AS north, CASE WHEN idx % 6 <> 1 THEN (idx * 7 % 360)::DOUBLE END AS heading FROM pose")
def s11_tile_names(spark, d):
    p = T.pose(spark, d)
    parts = [F.format_string("@%.4f", "e"), F.format_string("@%.4f", "n"), F.lit("@18@T@40.1@-73.9@pano@0"), F.concat(F.lit("@"), (F.col("idx") * 7 % 360).cast("string"))]
    tail = F.when(F.col("idx") % 6 != 1, F.lit("@0@0@1.5@20230101@note@.jpg")).otherwise("@.jpg")
    return readers.tile_name(p.select("seq", "idx", F.concat(*parts, tail).alias("path")), "path").select("seq", "idx", (F.round("east", 4) + 0.0).alias("east"), (F.round("north", 4) + 0.0).alias("north"), "heading")


@query(f"WITH {POSE} SELECT seq, idx FROM pose WHERE idx >= 10 AND idx < 90 AND (idx - 10) % 7 = 0")
def s14_slice(spark, d):
    return binning.slice_rows(T.pose(spark, d), 10, 90, 7).select("seq", "idx")


@query(f"WITH {RES} SELECT id, ref_seq, qry_seq, method AS vpr_method, seq_len, round(recall, 4) AS recall_at_1, round(runtime, 2) AS runtime FROM res")
def s15_damaged_header(spark, d):
    """Result CSVs whose header names other columns, the last run into data, read by the schema given."""
    folder = session.fresh_dir(spark, "results")
    have = results(spark, d).select("*", F.col("method").alias("vpr_method"), F.col("recall").alias("recall_at_1"), F.col("id").cast("int").alias("num_qry_frames"))
    names = [f.split()[0] for f in readers.RESULT_SCHEMA.split(", ")]
    cols = [F.col(c) if c in have.columns else F.lit(None).cast("string") for c in names]
    have.select(*(c.alias(f"{n}sunset1" if n == "patch_cols" else f"x{k}_{n}") for k, (n, c) in enumerate(zip(names, cols)))).write.csv(folder, header=True)
    r = readers.result_tables(spark, [folder])
    return r.select(F.col("num_qry_frames").cast("long").alias("id"), "ref_seq", "qry_seq", "vpr_method", "seq_len", F.round("recall_at_1", 4).alias("recall_at_1"), F.round("runtime", 2).alias("runtime"))


@query(f"WITH {DESC} SELECT 'q' AS side, q AS idx FROM pos WHERE r % 13 = 0 GROUP BY q UNION ALL SELECT 'r', idx FROM rs WHERE idx % 100 = 0")
def s17_bench_loader(spark, d):
    q, r = T.descriptors(spark, d)
    with_gt = T.positives(q, r).where("r % 13 = 0").select("q").distinct()
    return with_gt.select(F.lit("q").alias("side"), F.col("q").alias("idx")).unionByName(r.where("idx % 100 = 0").select(F.lit("r").alias("side"), "idx"))


@query(f"""WITH RECURSIVE {POSE}, q AS (SELECT seq, idx, e, n, (idx * 37) % 360 AS yaw FROM pose WHERE seq <> 'u2' AND e > -60 AND e < 60 AND n > -60 AND n < 60), r AS (SELECT idx, e, n, (idx * 53) % 360 AS yaw FROM pose WHERE seq = 'u2' AND e > -60 AND e < 60 AND n > -60 AND n < 60),
m AS (SELECT seq, q.idx, any_value(q.yaw) AS yaw, arg_min(r.yaw, (sqrt((q.e - r.e) ** 2 + (q.n - r.n) ** 2), r.idx)) AS ryaw, min(sqrt((q.e - r.e) ** 2 + (q.n - r.n) ** 2)) AS d FROM q, r GROUP BY seq, q.idx),
c AS (SELECT seq, 0 AS ord, idx, e, n, [idx] AS seen FROM q WHERE (seq, idx) IN (SELECT seq, min(idx) FROM q GROUP BY seq) UNION ALL
  SELECT seq, ord, idx, e, n, seen FROM (SELECT c.seq, c.ord + 1 AS ord, q.idx, q.e, q.n, list_append(c.seen, q.idx) AS seen,
    row_number() OVER (PARTITION BY c.seq ORDER BY sqrt((q.e - c.e) ** 2 + (q.n - c.n) ** 2), q.idx) AS rn FROM c JOIN q ON q.seq = c.seq AND NOT list_contains(c.seen, q.idx)) WHERE rn = 1)
SELECT seq, idx, ord::INT AS ord, round((idx % 256) / 127.5 - 1, 6) + 0.0 AS pixel FROM m JOIN c USING (seq, idx) WHERE d < 25 AND abs(((yaw - ryaw + 180) % 360 + 360) % 360 - 180) < 30""")
def s18_eval_loader(spark, d):
    """Every other track, in the order of its greedy tour, against one as the reference; a pixel value is scaled to -1..1."""
    p = trajectory.in_box(T.pose(spark, d), (-60, 60), (-60, 60))
    q = p.where("seq <> 'u2'").select(F.struct("seq", "idx").alias("q"), F.col("e").alias("qe"), F.col("n").alias("qn"))
    r = p.where("seq = 'u2'").select(F.col("idx").alias("r"), F.col("e").alias("re"), F.col("n").alias("rn"))
    near = joins.nearest_place_within(q, r, 25.0)
    yaw = trajectory.angle_diff(((F.col("q.idx") * 37) % 360).cast("double"), ((F.col("r") * 53) % 360).cast("double"))
    tour = trajectory.greedy_tour(p.where("seq <> 'u2'"))
    found = near.where(F.abs(yaw) < 30).select("q.seq", "q.idx", (F.round(similarity.unit_range(F.col("q.idx") % 256), 6) + 0.0).alias("pixel"))
    return found.join(tour, ["seq", "idx"])


@query(f"WITH {POSE} SELECT seq, idx FROM pose JOIN (SELECT seq, min(t) + 300000 AS a, min(t) + 900000 AS z FROM pose GROUP BY seq) USING (seq) WHERE NOT t BETWEEN a AND z")
def k7_loop_split(spark, d):
    p = T.pose(spark, d)
    loop = p.groupBy("seq").agg((F.min("t") + 300000).alias("t0"), (F.min("t") + 900000).alias("t1"))
    return readers.loop_split(p, loop).select("seq", "idx")


@query(f"WITH {SIM} SELECT run, q, r, round(s, 6) + 0.0 AS s, 2 AS reads FROM sim")
def k1_k3_k8_cached_table(spark, d):
    """The table of scores made once, read twice; a second making would show in the count. Scores that the cache has no room for are made as they are read."""
    folder, made, s = session.fresh_dir(spark, "cache"), [], T.scored(spark, d)
    make = lambda part: made.append(1) or S.rows(part)
    readers.cached_scores(spark, folder, s, make, metrics="l2 cosine sad")
    again = readers.cached_scores(spark, folder, s, make, metrics="l2 cosine sad")
    readers.write_once(again, folder)
    return again.select("run", "q", "r", "s", F.lit(3 - len(made)).alias("reads"))


@query(f"WITH {POSE}, c AS (SELECT seq, count(*) AS n FROM pose GROUP BY seq) SELECT *, unnest(['new', 'same', 'longer', 'damaged']) AS state, unnest([1, 1, 2, 3]) AS makings FROM c")
def k8_cache_validity(spark, d):
    """Made again when the duration differs or the table can't be read, and only then."""
    folder, made = session.fresh_dir(spark, "valid"), []
    make = lambda: made.append(1) or T.pose(spark, d).groupBy("seq").agg(F.count("*").alias("n"))
    out = None
    for state, duration in (("new", 60.0), ("same", 60.0), ("longer", 90.0), ("damaged", 90.0)):
        if state == "damaged":
            spark.createDataFrame([("?",)], "valid string").write.mode("overwrite").parquet(f"{folder}-properties")
        readers.cached(spark, folder, make, duration=duration, end=1200)
        one = spark.createDataFrame([(state, len(made))], "state string, makings int")
        out = one if out is None else out.unionByName(one)
    return readers.cached(spark, folder, make, duration=90.0, end=1200).crossJoin(F.broadcast(out))


@query(f"WITH {DESC}, a AS (SELECT 'q' AS side, idx, vec FROM qs UNION ALL SELECT 'r', idx, vec FROM rs) SELECT side, idx, len(vec)::INT AS dim, round(list_sum(vec), 6) + 0.0 AS total FROM a")
def k6_descriptor_sink(spark, d):
    """Written once in float32, as descriptors are kept; a second writing changes nothing."""
    folder = session.fresh_dir(spark, "descriptors")
    q, r = T.descriptors(spark, d)
    every = q.select(F.lit("q").alias("side"), "idx", "vec").unionByName(r.select(F.lit("r").alias("side"), "idx", "vec"))
    readers.write_once(every.withColumn("vec", F.col("vec").cast("array<float>")), folder, "side")
    readers.write_once(every.limit(1), folder, "side")
    back = spark.read.parquet(folder).withColumn("vec", F.col("vec").cast("array<double>"))
    return back.select("side", "idx", F.size("vec").alias("dim"), (F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"))


@query(f"WITH {RES} SELECT method, seq_len, count(*) AS n, round(sum(recall), 4) AS recall FROM res GROUP BY ALL")
def k4_append(spark, d):
    """Result rows appended in three runs."""
    folder, r = session.fresh_dir(spark, "append"), results(spark, d).select("id", "method", "seq_len", "recall")
    for k in range(3):
        readers.append(r.where(F.col("id") % 3 == k), folder)
    return spark.read.schema(r.schema).parquet(folder).groupBy("method", "seq_len").agg(F.count("*").alias("n"), F.round(F.sum("recall"), 4).alias("recall"))


@query("""WITH df AS (SELECT c_mktsegment AS dataset, count(*) AS radius, min(c_custkey) / 10 AS time_res, 1 AS patch FROM customer GROUP BY c_mktsegment)
SELECT c_custkey AS id, dataset, CASE WHEN c_custkey % 3 = 0 THEN time_res ELSE round(c_acctbal, 2) END AS time_res, CASE WHEN c_custkey % 2 = 0 THEN radius ELSE c_nationkey::BIGINT END AS radius,
  CASE WHEN c_custkey % 5 = 0 THEN patch ELSE c_custkey % 2 END <> 0 AS patch FROM customer JOIN df ON dataset = c_mktsegment""")
def k11_m16_config_overlay(spark, d):
    """A configuration per customer, some settings explicit, over the defaults of its segment."""
    c = T.table(spark, d, "customer")
    unless = lambda n, v: F.when(F.col("c_custkey") % n != 0, v)
    explicit = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("dataset"), unless(3, F.round("c_acctbal", 2)).alias("time_res"), unless(2, F.col("c_nationkey").cast("long")).alias("radius"), unless(5, F.col("c_custkey") % 2).alias("patch"))
    defaults = c.groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.count("*").alias("radius"), (F.min("c_custkey") / 10).alias("time_res"), F.lit(1).cast("long").alias("patch"))
    return readers.overlay_table(explicit, defaults, "dataset", ("patch",))


_ALLOWED = ", ".join(f"({k}, '{m}', '{b}', {x}, {j})" for k, (m, b, xs) in enumerate(models.ALLOWED) for j, x in enumerate(xs))
_METHODS = list(dict.fromkeys(m for m, _, _ in models.ALLOWED)) + ["unheard"]
_BACKBONES = [None, "ResNet50", "VGG16", "DINOv2", "ResNet18"]
_DIMS = [None, 512, 2048, 4096, 128, 5]


@query(f"""WITH al AS (SELECT * FROM (VALUES {_ALLOWED}) t(k, method, backbone, dim, j)), df AS (SELECT method, arg_min(backbone, (k, j)) AS b, arg_min(dim, (k, j)) AS n FROM al GROUP BY method),
c AS (SELECT p_partkey AS id, {_METHODS}[(p_partkey % {len(_METHODS)})::INT + 1] AS method, {str(_BACKBONES).replace("None", "NULL")}[(p_size % {len(_BACKBONES)})::INT + 1] AS backbone, {str(_DIMS).replace("None", "NULL")}[(p_partkey // 7 % {len(_DIMS)})::INT + 1] AS dim FROM part),
f AS (SELECT id, c.method, coalesce(backbone, b, '') AS backbone, coalesce(dim, n, 0)::INT AS dim FROM c LEFT JOIN df USING (method))
SELECT *, EXISTS (SELECT 1 FROM al WHERE al.method = f.method AND al.backbone = f.backbone AND al.dim = f.dim) AS valid FROM f""")
def k12_model_validation(spark, d):
    """A model configuration per part."""
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c % len(values)).cast("int") + 1)
    p = T.table(spark, d, "part")
    configs = p.select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey"), _METHODS).alias("method"), pick(F.col("p_size"), _BACKBONES).alias("backbone"), pick(F.floor(F.col("p_partkey") / 7), _DIMS).alias("dim"))
    return models.validate(configs).select("id", "method", F.coalesce("backbone", F.lit("")).alias("backbone"), F.coalesce("dim", F.lit(0)).alias("dim"), "valid")


# ------------------------------------------------------------ streams
EVENT_TS = "seq string, event_id long, t double, x int, y int, p int, ts timestamp"


def _stream(spark, d):
    folder = session.fresh_dir(spark, "stream")
    T.events(spark, d).withColumn("ts", F.timestamp_seconds("t")).repartitionByRange(4, "t").sortWithinPartitions("t").write.parquet(folder)
    return windows.event_stream(spark, folder, EVENT_TS), session.fresh_dir(spark, "stream-state")


def _name(kind):
    import uuid

    return f"{kind}_{uuid.uuid4().hex[:8]}"


@query(f"WITH {EV} SELECT (floor(t / 86400) * 86400)::BIGINT AS start_s, y, x, count(*) AS n, floor((tanh(count(*)) + 1) / 2 * 255)::INT AS v FROM ev GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    s, state = _stream(spark, d)
    out = windows.run_to_table(windows.tumbling_counts(s, "1 day"), _name("tumbling"), "complete", state)
    return out.select(F.unix_seconds("start").alias("start_s"), "y", "x", "n", "v")


@query(f"""WITH {EV}, k AS (SELECT p, t, unnest([floor(t / 43200) * 43200, floor(t / 43200) * 43200 - 43200]) AS a FROM ev)
SELECT a::BIGINT AS start_s, p, count(*) AS n FROM k WHERE t >= a AND t < a + 86400 GROUP BY ALL""")
def stream_sliding_counts(spark, d):
    s, state = _stream(spark, d)
    out = windows.run_to_table(windows.sliding_counts(s, "1 day", "12 hours"), _name("sliding"), "complete", state)
    return out.select(F.unix_seconds("start").alias("start_s"), "p", "n")


@query(f"""WITH {EV}, j AS (SELECT *, coalesce((t - lag(t) OVER w >= 2000)::INT, 0) AS j FROM ev WINDOW w AS (PARTITION BY seq ORDER BY t)),
s AS (SELECT *, sum(j) OVER (PARTITION BY seq ORDER BY t) AS segment FROM j) SELECT seq, floor(min(t))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY seq, segment HAVING count(*) >= 2""")
def stream_sessions(spark, d):
    s, state = _stream(spark, d)
    out = windows.run_to_table(windows.sessions(s, "2000 seconds"), _name("sessions"), "complete", state)
    return out.select("seq", F.unix_seconds("start").alias("start_s"), "n")


@query(f"""WITH RECURSIVE {EV}, nx AS (SELECT seq, t, min(t) OVER (PARTITION BY seq ORDER BY t RANGE BETWEEN 9000.5 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ev),
c AS (SELECT seq, t_first AS t FROM b UNION ALL SELECT c.seq, nx.nt FROM c JOIN nx ON nx.seq = c.seq AND nx.t = c.t WHERE nx.nt IS NOT NULL)
SELECT ev.seq, event_id, ev.t FROM ev JOIN c ON ev.seq = c.seq AND ev.t = c.t""")
def stream_min_gap_sample(spark, d):
    s, state = _stream(spark, d)
    return windows.run_to_table(windows.min_gap_sample(s, 9000.5), _name("gap"), "append", state)
