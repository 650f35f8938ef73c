"""Native file formats: written from the test tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..operators import binning
from ..sources import artefacts, bags, clustered, frames, hdf5, readers, sensor
from ..sources import tables as T
from . import query
from .ctes import DELTA, EV, POSE


def _hdf5_events(spark, d):
    """A folder per sequence of files that ascend in time."""
    hdf5.register(spark)
    folder = session.fresh_dir(spark, "hdf5")
    ev = T.events(spark, d).withColumn("ts_ns", F.rint(F.col("t") * 1e6).cast("long") * 1000)
    for s in ("s0", "s1", "s2"):
        one = ev.where(F.col("seq") == s).repartitionByRange(2, "ts_ns", "event_id").sortWithinPartitions("ts_ns", "event_id")
        cols = [F.col("ts_ns").alias("timestamps"), F.col("x").cast("short").alias("x_coordinates"), F.col("y").cast("short").alias("y_coordinates"), F.col("p").cast("boolean").alias("polarities"), F.col("event_id").alias("ids")]
        one.select(*cols).write.format("hdf5").mode("append").option("group", "events").option("rows", 20_000).option("chunk", 1000).save(f"{folder}/{s}")
    return folder


@query(f"""WITH {EV}, c AS (SELECT min(t) + 200000 AS a, min(t) + 1500000 AS z FROM ev)
SELECT seq, (t * 1e6)::BIGINT * 1000 AS ts_ns, x, y, p, count(*) AS n FROM ev, c WHERE (t * 1e6)::BIGINT BETWEEN (a * 1e6)::BIGINT AND (z * 1e6)::BIGINT GROUP BY ALL""")
def s2_hdf5_time_range(spark, d):
    """Two weeks of events; files and rows outside aren't read."""
    folder = _hdf5_events(spark, d)
    first = T.events(spark, d).agg(F.min("t")).head()[0]
    a, z = (round((first + s) * 1e6) * 1000 for s in (200_000, 1_500_000))
    out = None
    for s in ("s0", "s1", "s2"):
        one = readers.hdf5_events(spark, f"{folder}/{s}", rows=5000).where(F.col("ts_ns").between(a, z)).select(F.lit(s).alias("seq"), "ts_ns", "x", "y", "p")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("seq", "ts_ns", "x", "y", "p").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT seq, sum(event_id)::BIGINT AS ids, count(*) AS n, min((t * 1e6)::BIGINT) AS first_us FROM ev GROUP BY seq")
def s2_hdf5_columns(spark, d):
    """Two of five datasets, the rest of the files unread."""
    folder, out = _hdf5_events(spark, d), None
    for s in ("s0", "s1", "s2"):
        one = spark.read.format("hdf5").schema("ids long, timestamps long").option("group", "events").load(f"{folder}/{s}").withColumn("seq", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("seq").agg(F.sum("ids").alias("ids"), F.count("*").alias("n"), (F.min("timestamps") / 1000).cast("long").alias("first_us"))


@query(f"WITH {POSE} SELECT seq, count(*) AS n, round(sum(e), 4) + 0.0 AS e, round(sum(n), 4) + 0.0 AS north FROM pose GROUP BY seq")
def s13_hdf5_poses(spark, d):
    hdf5.register(spark)
    folder, out = session.fresh_dir(spark, "hdf5-poses"), None
    p = T.pose(spark, d).select("seq", (F.rint(F.col("t") * 1e6).cast("long") * 1000).alias("timestamps"), F.array("e", "n", F.lit(0.0)).alias("positions"))
    for k in range(8):
        p.where(F.col("seq") == f"u{k}").drop("seq").sort("timestamps").write.format("hdf5").mode("append").option("group", "pose_base_link").save(f"{folder}/u{k}")
        one = readers.hdf5_poses(spark, f"{folder}/u{k}").withColumn("seq", F.lit(f"u{k}"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("seq").agg(F.count("*").alias("n"), (F.round(F.sum("e"), 4) + 0.0).alias("e"), (F.round(F.sum("n"), 4) + 0.0).alias("north"))


@query(f"""WITH RECURSIVE {POSE}, im AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS row, t, (idx % 251) AS v FROM (SELECT seq, t, min(idx) AS idx FROM pose GROUP BY seq, t)),
nx AS (SELECT seq, t, min(t) OVER (PARTITION BY seq ORDER BY t RANGE BETWEEN 43200 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM im),
c AS (SELECT seq, min(t) AS t FROM im GROUP BY seq UNION ALL SELECT c.seq, nx.nt FROM c JOIN nx ON nx.seq = c.seq AND nx.t = c.t WHERE nx.nt IS NOT NULL)
SELECT im.seq, im.row, 12 * v AS total, 12::INT AS size FROM im JOIN c ON c.seq = im.seq AND c.t = im.t""")
def s13_hdf5_images(spark, d):
    """Images of 3 x 4 pixels, of which those half a day apart are read."""
    hdf5.register(spark)
    folder, out = session.fresh_dir(spark, "hdf5-images"), None
    p = T.pose(spark, d).groupBy("seq", "t").agg(F.min("idx").alias("idx"))
    image = F.unhex(F.repeat(F.lpad(F.lower(F.hex(F.col("idx") % 251)), 2, "0"), 12))
    for k in range(8):
        one = p.where(F.col("seq") == f"u{k}").coalesce(1).sortWithinPartitions("t").select((F.rint(F.col("t") * 1e6).cast("long") * 1000).alias("timestamps"), image.alias("images"))
        one.write.format("hdf5").mode("append").option("group", "image_raw").option("shape", "3,4").option("chunk", 64).save(f"{folder}/u{k}")
        back = readers.hdf5_images(spark, f"{folder}/u{k}", 43200.0).withColumn("seq", F.lit(f"u{k}"))
        out = back if out is None else out.unionByName(back)
    total = F.aggregate(F.split(F.hex("images"), "(?<=\\G..)"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.conv(F.when(x != "", x), 16, 10).cast("long"), F.lit(0)))
    return out.select("seq", "row", total.alias("total"), F.length("images").alias("size"))


@query(f"WITH {EV} SELECT seq, (t * 1e6)::BIGINT AS t_us, x, y, p, count(*) AS n FROM ev GROUP BY ALL")
def s5_raw_sensor(spark, d):
    """Written as a sensor's words, three files a sequence, and read in splits of 2000 bytes."""
    sensor.register(spark)
    folder, out = session.fresh_dir(spark, "raw"), None
    ev = T.events(spark, d).select("seq", F.rint(F.col("t") * 1e6).cast("long").alias("t_us"), "x", "y", "p")
    for s in ("s0", "s1", "s2"):
        one = ev.where(F.col("seq") == s).drop("seq").repartitionByRange(3, "t_us").sortWithinPartitions("t_us")
        one.write.format("evt3").mode("append").save(f"{folder}/{s}")
        back = sensor.raw_events(spark, f"{folder}/{s}", 2000).withColumn("seq", F.lit(s))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("seq", "t_us", "x", "y", "p").agg(F.count("*").alias("n"))


def _clustered(spark, d, files=12):
    folder = session.fresh_dir(spark, "clustered")
    clustered.write(T.events(spark, d), folder, "seq", "t", files, 1 << 14)
    return folder


@query(f"""WITH {EV}, g AS (SELECT seq, unnest(range(-1, 40)) AS k, t_first, t_last FROM b UNION ALL SELECT 'none', 1, 0, 10),
q AS (SELECT DISTINCT seq, CASE k WHEN 39 THEN t_last ELSE t_first + k * 86400.0::DOUBLE END AS t FROM g)
SELECT q.seq, q.t, (SELECT count(*) FROM ev WHERE ev.seq = q.seq AND ev.t < q.t) AS before, (SELECT count(*) FROM ev WHERE ev.seq = q.seq AND ev.t <= q.t) AS upto FROM q""")
def w13_searchsorted(spark, d):
    """The places of each day's start, of times before the first and after the last event, and of an unknown sequence."""
    folder = _clustered(spark, d)
    b = T.bounds(T.events(spark, d))
    k = b.select("seq", F.explode(F.sequence(F.lit(-1), F.lit(39))).alias("k"), "t_first", "t_last")
    at = k.select("seq", F.when(F.col("k") == 39, F.col("t_last")).otherwise(F.col("t_first") + F.col("k") * 86400.0).alias("t"))
    at = at.unionByName(spark.createDataFrame([("none", 86400.0)], "seq string, t double")).distinct()
    left, right = (clustered.searchsorted(spark, folder, "seq", "t", at, side).withColumnRenamed("place", name) for side, name in (("left", "before"), ("right", "upto")))
    return left.join(right, ["seq", "t"])


@query(f"WITH {EV} SELECT ev.seq, event_id, t, x, y, p FROM ev JOIN b USING (seq) WHERE ev.seq = 's1' AND t BETWEEN t_first + 432000 AND t_first + 864000")
def w13_time_range(spark, d):
    folder = _clustered(spark, d)
    first = T.events(spark, d).where("seq = 's1'").agg(F.min("t")).head()[0]
    return clustered.read_range(spark, folder, "seq", "t", "s1", first + 432_000, first + 864_000)


@query(f"""WITH {EV}, c AS (SELECT seq, bin_id, y, x, least(count(*), 255) AS v FROM be GROUP BY ALL)
SELECT seq, bin_id AS idx, sum(v)::BIGINT AS total, max(v)::INT AS most, 192::INT AS size FROM c GROUP BY seq, bin_id""")
def k1_frame_sink(spark, d):
    """A frame of counts for each bin, written twice as an image file, and read back by name."""
    frames.register(spark)
    folder, out = session.fresh_dir(spark, "frames"), None
    ev = T.events(spark, d)
    binned = binning.assign_time_bins(ev, T.bounds(ev), DELTA)
    counts = binned.groupBy("seq", "bin_id", "y", "x").agg(F.least(F.count("*"), F.lit(255)).alias("v"))
    name = F.concat("seq", F.lit("/@"), F.format_string("%.6f@%.6f", F.col("bin_id") * 1.5, F.col("bin_id") * -2.0), F.lit("@frame_"), F.col("bin_id").cast("string"), F.lit("@.png"))
    dense = frames.dense(counts, ["seq", "bin_id"], name, T.HEIGHT, T.WIDTH).select("name", "height", "width", "channels", "pixels")
    for _ in range(2):
        dense.write.format("frames").mode("append").save(folder)
    back = readers.frame_name(frames.read_frames(spark, folder), "path").withColumn("seq", F.element_at(F.split("path", "/"), -2))
    values = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda k: F.conv(F.hex(F.substring("pixels", k, 1)), 16, 10).cast("int"))
    back = back.withColumn("values", values)
    return back.select("seq", "idx", F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("values").alias("most"), F.length("pixels").alias("size"))


@query(f"WITH {EV} SELECT seq, (t * 1e6)::BIGINT * 1000 AS t_ns, x, y, p, count(*) AS n FROM ev GROUP BY ALL")
def s16_bag_events(spark, d):
    """Written as bags of compressed chunks, each chunk read as a partition."""
    bags.register(spark)
    folder, out = session.fresh_dir(spark, "bags"), None
    ev = T.events(spark, d).select("seq", (F.rint(F.col("t") * 1e6).cast("long") * 1000).alias("t_ns"), "x", "y", "p")
    for s in ("s0", "s1", "s2"):
        one = ev.where(F.col("seq") == s).drop("seq").repartitionByRange(2, "t_ns").sortWithinPartitions("t_ns")
        one.write.format("bag_events").mode("append").option("topic", f"/{s}/events").option("chunk", 50).option("compression", "bz2").save(f"{folder}/{s}")
        back = spark.read.format("bag_events").option("topic", f"/{s}/events").load(f"{folder}/{s}")
        out = back if out is None else out.unionByName(back)
    return out.groupBy(F.split("topic", "/")[1].alias("seq"), "t_ns", "x", "y", "p").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, f AS (SELECT min(t) AS a FROM ev) SELECT seq, count(*) AS n, sum(x)::BIGINT AS xs FROM ev, f WHERE t >= a + 400000 AND t < a + 500000 GROUP BY seq")
def s16_bag_time_range(spark, d):
    bags.register(spark)
    folder, out = session.fresh_dir(spark, "bags"), None
    ev = T.events(spark, d).select("seq", (F.rint(F.col("t") * 1e6).cast("long") * 1000).alias("t_ns"), "x", "y", "p")
    first = round(T.events(spark, d).agg(F.min("t")).head()[0] * 1e6) * 1000
    for s in ("s0", "s1", "s2"):
        ev.where(F.col("seq") == s).drop("seq").sort("t_ns").write.format("bag_events").mode("append").option("topic", f"/{s}/events").option("chunk", 50).save(f"{folder}/{s}")
        back = spark.read.format("bag_events").load(f"{folder}/{s}").where((F.col("t_ns") >= first + 400_000 * 10**9) & (F.col("t_ns") < first + 500_000 * 10**9))
        out = back if out is None else out.unionByName(back)
    return out.groupBy(F.split("topic", "/")[1].alias("seq")).agg(F.count("*").alias("n"), F.sum("x").alias("xs"))


@query("""WITH m AS (SELECT s_suppkey AS k, 'old/' || s_suppkey || '.npy' AS old, 'new/' || (CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 1 ELSE s_suppkey END) || '_1_1.npy' AS new FROM supplier)
SELECT old, new, CASE WHEN k % 7 = 1 THEN 'missing' WHEN k % 5 = 0 THEN 'kept' WHEN k % 10 = 3 AND (k - 1) % 5 = 0 THEN 'kept' WHEN new IN (SELECT new FROM m b WHERE b.k % 7 <> 1 AND b.old < m.old) THEN 'clash' ELSE 'moved' END AS state,
  CASE WHEN k % 7 = 1 THEN 0 ELSE 1 END AS files FROM m""")
def k9_artefact_move(spark, d):
    """An artefact per supplier: some missing, some with a file at the new place, some with the same new place; moved twice."""
    folder = session.fresh_dir(spark, "artefacts")
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    old = F.concat(F.lit("old/"), F.col("k").cast("string"), F.lit(".npy"))
    to = F.when(F.col("k") % 10 == 3, F.col("k") - 1).otherwise(F.col("k"))
    new = F.concat(F.lit("new/"), to.cast("string"), F.lit("_1_1.npy"))

    def put(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(name.encode())
            yield b

    had = s.where("k % 7 <> 1").select(old.alias("name")).unionByName(s.where("k % 5 = 0").select(F.concat(F.lit("new/"), F.col("k").cast("string"), F.lit("_1_1.npy")).alias("name")))
    had.mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
    manifest = s.select(old.alias("old"), new.alias("new"))
    done = artefacts.move(manifest, folder)
    again = artefacts.move(manifest, folder).where("state = 'moved'")  # nothing is left to move
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.decode("content", "UTF-8").alias("old"))
    kept = done.join(again.select("old").withColumn("twice", F.lit(1)), "old", "left").where("twice is null").drop("twice")
    return kept.join(files.groupBy("old").agg(F.count("*").cast("int").alias("files")), "old", "left").select("old", "new", "state", F.coalesce("files", F.lit(0)).alias("files"))
