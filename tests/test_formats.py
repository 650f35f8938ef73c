"""Native file formats: layouts made by hand, round trips, pruning, failed writes."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.sources import clustered, frames, hdf5, readers, sensor, storage


# ------------------------------------------------------------ HDF5
def hdf5_file(path, group, columns, chunk=7):
    with open(path, "wb") as f:
        f.writelines(hdf5.Builder().file(group, columns, chunk))


def test_hdf5_kinds_and_chunks(spark, tmp_path):
    hdf5.register(spark)
    n = 1000  # more chunks than a node of the tree holds, more members than a leaf
    cols = {f"c{k:02d}": np.arange(n, dtype="i4") * k for k in range(11)}
    cols |= {"f4": np.linspace(-1, 1, n, dtype="f4"), "u4": np.full(n, 2**32 - 1, "u4"), "flag": np.arange(n) % 2 == 0, "i1": (np.arange(n) % 100 - 50).astype("i1")}
    cols |= {"xyz": np.arange(3.0 * n).reshape(n, 3), "image": np.arange(6 * n).reshape(n, 2, 3).astype("u1")}
    hdf5_file(tmp_path / "a.h5", "one/two", cols)
    df = spark.read.format("hdf5").option("group", "one/two").option("rows", 90).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 12
    assert dict(df.dtypes) == {f"c{k:02d}": "int" for k in range(11)} | {"f4": "float", "u4": "bigint", "flag": "tinyint", "i1": "tinyint", "xyz": "array<double>", "image": "binary", "file": "string", "row": "bigint"}
    rows = df.sort("row").collect()
    assert [r["row"] for r in rows] == list(range(n)) and rows[0]["file"] == "a.h5"
    for k in (0, 6, 7, 500, 999):
        r = rows[k]
        assert [r[f"c{j:02d}"] for j in range(11)] == [k * j for j in range(11)]
        assert r["f4"] == pytest.approx(cols["f4"][k]) and r["u4"] == 2**32 - 1 and r["flag"] == (k % 2 == 0) and r["i1"] == cols["i1"][k]
        assert r["xyz"] == [3.0 * k, 3 * k + 1, 3 * k + 2] and bytes(r["image"]) == cols["image"][k].tobytes()


def test_hdf5_contiguous_big_endian_and_missing(spark, tmp_path):
    """A contiguous dataset, as files without filters have, made by hand."""
    hdf5.register(spark)
    b = hdf5.Builder()
    x = np.arange(50, dtype=">i8")
    space = struct.pack("<BBB5x", 1, 1, 0) + struct.pack("<Q", 50)
    kind = struct.pack("<BBBBIHH", 0x10, 9, 0, 0, 8, 0, 64)
    at = b.add(x.tobytes())
    plain = b.add(hdf5._header(hdf5._message(hdf5.DATASPACE, space), hdf5._message(hdf5.DATATYPE, kind), hdf5._message(hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, at, 400))))
    never = b.add(hdf5._header(hdf5._message(hdf5.DATASPACE, space), hdf5._message(hdf5.DATATYPE, kind), hdf5._message(hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, hdf5.NOWHERE, 0))))
    root = b.group({"t": plain, "zero": never})
    head = hdf5.SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, b.end, hdf5.NOWHERE) + struct.pack("<QQI4xQQ", 0, root[0], 1, root[1], root[2])
    (tmp_path / "b.hdf5").write_bytes(b"".join([head, *b.parts[1:]]))
    got = spark.read.format("hdf5").option("rows", 20).load(str(tmp_path)).sort("row").collect()
    assert [r["t"] for r in got] == list(range(50)) and {r["zero"] for r in got} == {0}


def test_hdf5_filters_prune(spark, tmp_path):
    hdf5.register(spark)
    t = np.sort(np.random.default_rng(0).integers(0, 10**6, 5000))
    hdf5_file(tmp_path / "a.h5", "events", {"t": t}, 100)
    hdf5_file(tmp_path / "b.h5", "events", {"t": t + 10**6}, 100)
    df = spark.read.format("hdf5").option("group", "events").option("sorted", "t").option("rows", 100).load(str(tmp_path))
    for cond, want in [("t >= 300000 and t < 320000", (t >= 300000) & (t < 320000)), ("t = 5", t == 5), (f"t > {t[77]} and t <= {t[80]}", (t > t[77]) & (t <= t[80])), ("row >= 4990 and t < 1000000", np.arange(5000) >= 4990)]:
        part = df.where(cond)
        assert sorted(r["t"] for r in part.collect()) == t[want].tolist()
        assert part.rdd.getNumPartitions() <= want.sum() // 100 + 2  # of 100


def test_hdf5_bounds_are_rows_of_the_file(tmp_path):
    t = np.array([1, 1, 2, 2, 2, 5, 9])
    hdf5_file(tmp_path / "a.h5", "/", {"t": t}, 2)
    with open(tmp_path / "a.h5", "rb") as f:
        rows = hdf5.Rows(f, hdf5.Layout(f).group("/")["t"])
        for v in range(-1, 11):
            assert rows.lower_bound(v, False) == np.searchsorted(t, v, "left") and rows.lower_bound(v, True) == np.searchsorted(t, v, "right")


def test_hdf5_failed_task_leaves_nothing(spark, tmp_path):
    hdf5.register(spark)
    df = spark.range(0, 100, 1, 4)
    fails = df.select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).cast("long").alias("v"))
    with pytest.raises(Exception, match="stop"):
        fails.write.format("hdf5").mode("append").option("rows", 5).save(str(tmp_path))
    assert storage.listing(str(tmp_path), (".h5",)) == []  # a task that outlives the job may leave staged files, which nobody reads
    df.write.format("hdf5").mode("append").option("rows", 5).save(str(tmp_path))
    df.write.format("hdf5").mode("append").save(str(tmp_path))
    load = lambda: spark.read.format("hdf5").load(str(tmp_path))
    assert load().count() == 200 and len(storage.listing(str(tmp_path), (".h5",))) == 24
    df.write.format("hdf5").mode("overwrite").save(str(tmp_path))
    assert sorted(r["id"] for r in load().collect()) == list(range(100))


def test_hdf5_no_files_and_empty(spark, tmp_path):
    hdf5.register(spark)
    assert spark.read.format("hdf5").schema("t long").load(str(tmp_path)).count() == 0
    hdf5_file(tmp_path / "a.h5", "/", {"t": np.zeros(0, "i8")})
    assert spark.read.format("hdf5").load(str(tmp_path)).count() == 0


# ------------------------------------------------------------ sensor words
def plain_decoder(words):
    """One word at a time."""
    y = low = high = rounds = base = base_p = 0
    seen, out = None, []
    for k, w in enumerate(words):
        kind, v = w >> 12, w & 0xFFF
        t = lambda: (rounds << 24) + (high << 12) + low
        if kind == 0:
            y = v & 0x7FF
        elif kind == 2:
            out.append((k * 16, t(), v & 0x7FF, y, v >> 11))
        elif kind == 3:
            base, base_p = v & 0x7FF, v >> 11
        elif kind in (4, 5):
            size = 12 if kind == 4 else 8
            out += [(k * 16 + i, t(), base + i, y, base_p) for i in range(size) if v >> i & 1]
            base += size
        elif kind == 6:
            low = v
        elif kind == 8:
            if seen is not None and v - high < -2048:
                rounds += 1
            seen = high = v
    return out


def random_words(n, seed):
    r, out, high = random.Random(seed), [], 4000
    for _ in range(n):
        kind = r.choice([0, 2, 2, 3, 4, 5, 6, 8, 8, 0xA, 0xE])
        if kind == 8:
            high = (high + r.randrange(0, 900)) % 4096
            out.append(8 << 12 | high)
        else:
            out.append(kind << 12 | r.randrange(4096))
    return np.array(out, np.uint32)


def test_words_from_any_state():
    words = random_words(3000, 1)
    whole = plain_decoder(words.tolist())
    zero = {"y": 0, "low": 0, "high": 0, "rounds": 0, "base": 0, "base_p": 0}
    got = sensor.decode(words, 0, zero)
    assert list(zip(*(got[c].tolist() for c in ("place", "t_us", "x", "y", "p")))) == whole


@pytest.mark.parametrize("split_bytes", [2, 6, 101, 4000, 1 << 20])
def test_any_split_reads_alike(spark, tmp_path, split_bytes):
    n = 300 if split_bytes < 10 else 3000
    want = []
    for name, seed in (("a", 2), ("b", 3)):
        words = random_words(n, seed)
        (tmp_path / f"{name}.raw").write_bytes(b"% evt 3.0\n% first_us 1000\n" + words.astype("<u2").tobytes() + b"x")
        want += [(f"{name}.raw", k, t + 1000, x, y, p) for k, t, x, y, p in plain_decoder(words.tolist())]
    (tmp_path / "empty.raw").write_bytes(b"% evt 3.0\n")
    assert sorted(map(tuple, sensor.raw_events(spark, str(tmp_path), split_bytes).collect())) == sorted(want)


def test_encoder_round_trip():
    r = np.random.default_rng(4)
    t = np.sort(np.concatenate([r.integers(0, 5000, 300), r.integers(0, 10**9, 200), [3 * 10**9]]))
    x, y, p = r.integers(0, 2048, 501), r.integers(0, 720, 501), r.integers(0, 2, 501)
    words = sensor.encode(t, x, y, p)
    got = plain_decoder(words.tolist())
    assert [g[1:] for g in got] == list(zip(t.tolist(), x.tolist(), y.tolist(), p.tolist()))


def test_raw_sink_over_many_batches(spark, tmp_path):
    sensor.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(400).select((F.col("id") * F.col("id") * 977 + 10**12).alias("t_us"), (F.col("id") % 640).cast("int").alias("x"), (F.col("id") % 7).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("p"))
        df.coalesce(1).write.format("evt3").mode("append").save(str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = sensor.raw_events(spark, str(tmp_path), 64).sort("place").select("t_us", "x", "y", "p").collect()
    assert [tuple(r) for r in got] == [(k * k * 977 + 10**12, k % 640, k % 7, k % 2) for k in range(400)]
    with pytest.raises(Exception, match="sorted by time"):
        df.coalesce(1).sortWithinPartitions(F.desc("t_us")).write.format("evt3").mode("append").save(str(tmp_path))


# ------------------------------------------------------------ tables laid out by time
def scanned(df):
    """Rows that the scans of a plan gave out, after it has run."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName() in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            plan.append(p.plan())
            continue
        if "FileSourceScan" in p.getClass().getSimpleName():
            total += p.metrics().get("numOutputRows").get().value()
        plan += [p.children().apply(k) for k in range(p.children().size())]
    return total


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered"))
    r = np.random.default_rng(7)
    rows = [(s, float(t), k) for s in ("a", "b", None) for k, t in enumerate(np.round(r.uniform(0, 1000, 20_000), 1))] + [("c", 5.0, 0), ("a", None, 1)]
    df = spark.createDataFrame(rows, "seq string, t double, v long")
    clustered.write(df, path, "seq", "t", 8, 1 << 13)
    return path, rows


def test_time_range_reads_little(spark, layout):
    path, rows = layout
    for key in ("a", None, "c", "nobody"):
        df = clustered.read_range(spark, path, "seq", "t", key, 300.0, 310.0)
        want = sorted((s, t, v) for s, t, v in rows if s == key and t is not None and 300 <= t <= 310)
        assert sorted(map(tuple, df.collect())) == want
    df = clustered.read_range(spark, path, "seq", "t", "a", 300.0, 310.0)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(t,300.0)" in plan and "LessThanOrEqual(t,310" in plan
    assert scanned(df) < 6000  # of 60,001: one file of eight, and of its row groups those that meet the range


@pytest.mark.parametrize("side", ["left", "right"])
def test_searchsorted(spark, layout, side):
    path, rows = layout
    asked = [("a", t) for t in (-1.0, 0.0, 12.3, 500.05, 999.9, 1000.0, 1e9)] + [("b", 77.7), (None, 77.7), ("c", 5.0), ("c", 4.0), ("c", 6.0), ("nobody", 1.0)]
    asked += [("b", t) for s, t, v in rows if s == "b" and v % 3000 == 0]
    got = {(r["seq"], r["t"]): r["place"] for r in clustered.searchsorted(spark, path, "seq", "t", spark.createDataFrame(asked, "seq string, t double"), side).collect()}
    for key, t in asked:
        own = np.sort([x for s, x, _ in rows if s == key and x is not None])
        assert got.pop((key, t)) == np.searchsorted(own, t, side), (key, t)
    assert not got


# ------------------------------------------------------------ frames
def test_png_filters():
    """Every way a row may be filtered, by a plain decoder's inverse."""
    r = np.random.default_rng(1)
    for shape in ((7, 5), (6, 4, 3), (1, 1)):
        pixels = r.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(frames.decode(frames.encode(pixels)), pixels)
        step, rows = (3 if len(shape) == 3 else 1), pixels.reshape(shape[0], -1).astype(int)
        raw = b""
        for k, row in enumerate(rows):
            how, up = k % 5, rows[k - 1] if k else np.zeros_like(row)
            left = lambda v: np.concatenate([np.zeros(step, int), v[:-step]])  # noqa: B023, E731
            a, b, c = left(row), up, left(up)
            p = np.abs(a + b - c - a), np.abs(a + b - c - b), np.abs(a + b - c - c)
            paeth = np.where((p[0] <= p[1]) & (p[0] <= p[2]), a, np.where(p[1] <= p[2], b, c))
            guess = [0 * row, a, b, (a + b) // 2, paeth][how]
            raw += bytes([how]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        plain = frames.encode(pixels)
        at = plain.index(b"IDAT")
        body = zlib.compress(raw)
        crafted = plain[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + plain[-12:]
        assert np.array_equal(frames.decode(crafted), pixels)
    assert frames.decode(b"GIF89a") is None


def test_frames_dense_and_sink(spark, tmp_path):
    frames.register(spark)
    rows = [(1, 0, 0, 7), (1, 2, 3, 255), (1, 2, 3, 9), (1, 9, 9, 1), (2, 1, 1, 300), (2, 0, 1, 30), (3, 5, 5, 1)]
    pix = spark.createDataFrame(rows, "k int, y int, x int, v int")
    name = F.concat(F.lit("@1@2@frame_"), F.col("k").cast("string"), F.lit("@.png"))
    df = frames.dense(pix, ["k"], name, 3, 4)
    got = {r["k"]: np.frombuffer(r["pixels"], np.uint8).reshape(3, 4) for r in df.collect()}
    one = np.zeros((3, 4), np.uint8)
    one[0, 0], one[2, 3] = 7, 255
    assert np.array_equal(got[1], one) and got[3].sum() == 0
    assert got[2][1, 1] == 255 and got[2][0, 1] == 25  # shares of the largest
    out = df.select("name", "height", "width", "channels", "pixels")
    out.write.format("frames").mode("append").save(str(tmp_path))
    files = sorted(tmp_path.glob("*.png"))
    assert [f.name for f in files] == [f"@1@2@frame_{k}@.png" for k in (1, 2, 3)]
    files[1].unlink()
    files[0].write_bytes(b"as it was")
    out.unionByName(out.withColumn("height", F.lit(99))).write.format("frames").mode("append").save(str(tmp_path))
    assert files[0].read_bytes() == b"as it was" and np.array_equal(frames.decode(files[1].read_bytes()), got[2])
    out.write.format("frames").mode("overwrite").save(str(tmp_path))
    back = {r["path"].split("frame_")[1][0]: bytes(r["pixels"]) for r in frames.read_frames(spark, str(tmp_path)).collect()}
    assert back == {str(k): v.tobytes() for k, v in got.items()}
    assert [r["idx"] for r in readers.frame_files(spark, str(tmp_path)).collect()] == [1, 2, 3]


def test_frames_failed_job_leaves_nothing(spark, tmp_path):
    frames.register(spark)
    df = spark.range(0, 40, 1, 4).select(F.format_string("f%d.png", "id").alias("name"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(1).alias("channels"), F.when(F.col("id") < 39, F.unhex(F.lit("07"))).otherwise(F.raise_error(F.lit("stop")).cast("binary")).alias("pixels"))
    with pytest.raises(Exception, match="stop"):
        df.write.format("frames").mode("append").save(str(tmp_path))
    assert storage.listing(str(tmp_path), (".png",)) == []


def test_colour_frames(spark, tmp_path):
    pix = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 0, 0, 2, 1.0), (0, 1, 1, 1, 0.25)], "k int, y int, x int, c int, v double")
    r = frames.dense(pix, ["k"], F.lit("a.png"), 2, 2, channel="c").head()
    assert np.frombuffer(r["pixels"], np.uint8).reshape(2, 2, 3).tolist() == [[[127, 0, 255], [0, 0, 0]], [[0, 0, 0], [0, 63, 0]]]


def test_index_of_image_paths(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "@1@2@frame_4@.jpg").write_bytes(b"x")
    (tmp_path / "set" / "unlisted@frame_9@.jpg").write_bytes(b"x")
    assert readers.frame_files(spark, str(tmp_path / "set")).count() == 2
    (tmp_path / "set_images_paths.txt").write_text("@1@2@frame_4@.jpg\nsub/@3@4@frame_2@.jpg\n")
    assert [(r["idx"], r["east"]) for r in readers.frame_files(spark, str(tmp_path / "set")).collect()] == [(2, 3.0), (4, 1.0)]
