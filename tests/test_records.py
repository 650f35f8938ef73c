"""Bags, videos, models over frames, search, moves, overlays."""

import bz2
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import inference, search
from eventloom.sources import artefacts, bags, readers, storage, videos


# ------------------------------------------------------------ bags
def bag_rows(spark, n=2000):
    return spark.range(n).select((F.col("id") * 1_000_001 + 10**18).alias("t_ns"), (F.col("id") % 640).cast("int").alias("x"), (F.col("id") % 480).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("p"))


@pytest.mark.parametrize("how", ["none", "bz2"])
def test_bag_round_trip_and_pruning(spark, tmp_path, how):
    bags.register(spark)
    df = bag_rows(spark)
    df.coalesce(1).sortWithinPartitions("t_ns").write.format("bag_events").mode("append").option("chunk", 10).option("compression", how).save(str(tmp_path))
    back = spark.read.format("bag_events").load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 13  # chunks of 160 events
    want = sorted(map(tuple, df.collect()))
    assert sorted((r["t_ns"], r["x"], r["y"], r["p"]) for r in back.collect()) == want
    t = want[500][0]
    part = back.where((F.col("t_ns") >= t) & (F.col("t_ns") < t + 10 * 1_000_001))
    assert part.rdd.getNumPartitions() <= 2 and part.count() == 10
    assert [r["y"] for r in spark.read.format("bag_events").schema("y int, t_ns long").load(str(tmp_path)).where(f"t_ns = {t}").collect()] == [500 % 480]
    assert spark.read.format("bag_events").option("topic", "/other").load(str(tmp_path)).count() == 0


def test_bag_of_several_topics_made_by_hand(spark, tmp_path):
    """Two connections, one of another type, messages of both in one chunk; a header that names the frame."""
    bags.register(spark)
    rec = bags._record
    conn = lambda c, topic, kind: rec({"op": b"\x07", "conn": struct.pack("<I", c), "topic": topic}, struct.pack("<I", 5 + len(kind)) + b"type=" + kind)
    e = np.array([(7, 8, 3, 9, 1), (1, 2, 3, 10, 0)], bags.EVENT)
    message = struct.pack("<III", 0, 3, 9) + struct.pack("<I", 3) + b"dvs" + struct.pack("<III", 260, 346, 2) + e.tobytes()
    body = conn(0, b"/left", b"dvs_msgs/EventArray") + conn(1, b"/imu", b"sensor_msgs/Imu") + rec({"op": b"\x02", "conn": struct.pack("<I", 1), "time": bytes(8)}, b"imu") + rec({"op": b"\x02", "conn": struct.pack("<I", 0), "time": bytes(8)}, message)
    chunk = rec({"op": b"\x05", "compression": b"bz2", "size": struct.pack("<I", len(body))}, bz2.compress(body))
    at = len(bags.VERSION) + 4096
    head = rec({"op": b"\x03", "index_pos": struct.pack("<Q", at + len(chunk)), "conn_count": struct.pack("<I", 2), "chunk_count": struct.pack("<I", 1)}, b"")
    n = struct.unpack_from("<I", head)[0]
    head = head[: 4 + n] + struct.pack("<I", 4088 - n) + b" " * (4088 - n)
    info = rec({"op": b"\x06", "ver": struct.pack("<I", 1), "chunk_pos": struct.pack("<Q", at), "start_time": struct.pack("<II", 3, 9), "end_time": struct.pack("<II", 3, 10), "count": struct.pack("<I", 2)}, b"")
    (tmp_path / "a.bag").write_bytes(bags.VERSION + head + chunk + conn(0, b"/left", b"dvs_msgs/EventArray") + conn(1, b"/imu", b"sensor_msgs/Imu") + info)
    got = spark.read.format("bag_events").load(str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a.bag", "/left", 3 * 10**9 + 9, 7, 8, 1), ("a.bag", "/left", 3 * 10**9 + 10, 1, 2, 0)]
    (tmp_path / "b.bag").write_bytes(b"#ROSBAG V1.2\n")
    with pytest.raises(Exception, match="version 2.0"):
        spark.read.format("bag_events").load(str(tmp_path)).count()


def test_bags_roll_over(spark, tmp_path, monkeypatch):
    w = bags.BagWriter(str(tmp_path), chunk=5, bag_bytes=6000)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": lambda s: 0})())
    made = w.write(iter(bag_rows(spark, 400).toArrow().to_batches()))
    assert len(made.names) > 1 and made.rows == 400
    w.commit([made])
    bags.register(spark)
    assert spark.read.format("bag_events").load(str(tmp_path)).count() == 400


# ------------------------------------------------------------ video
def test_video_strides_crops_and_colour(spark, tmp_path):
    videos.register(spark)
    r = np.random.default_rng(0)
    luma = r.integers(0, 256, (10, 5, 7)).astype(np.uint8)
    colour = bytes(2 * 4 * 3)  # half size each way, rounded up
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W7 H5 F30000:1001 Ip A1:1 C420jpeg\n" + b"".join(b"FRAME\n" + f.tobytes() + colour for f in luma))
    load = lambda **o: spark.read.format("y4m").options(**o).load(str(tmp_path))
    rows = load(rows=3).sort("frame").collect()
    assert [r["frame"] for r in rows] == list(range(10)) and all(bytes(r["pixels"]) == luma[r["frame"]].tobytes() for r in rows)
    assert rows[3]["t"] == pytest.approx(3 * 1001 / 30000) and (rows[0]["height"], rows[0]["width"]) == (5, 7)
    some = load(every=4, crop=2, rows=1).sort("frame").collect()
    assert [(r["frame"], r["height"], bytes(r["pixels"])) for r in some] == [(k, 3, luma[k, :3].tobytes()) for k in (0, 4, 8)]
    late = load(rows=1).where("frame > 6 and frame <= 8")
    assert late.rdd.getNumPartitions() <= 3 and sorted(r["frame"] for r in late.collect()) == [7, 8]
    assert load().select("frame").count() == 10


def test_video_sink_wants_one_size(spark, tmp_path):
    videos.register(spark)
    df = spark.createDataFrame([(0, 1, 2, b"ab"), (1, 2, 2, b"abcd")], "frame long, height int, width int, pixels binary").coalesce(1)
    with pytest.raises(Exception, match="one size"):
        df.write.format("y4m").mode("append").save(str(tmp_path))
    assert storage.listing(str(tmp_path), (".y4m",)) == []


# ------------------------------------------------------------ models
def frames(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{k % 2}", k, 4 + k % 3, 5, r.integers(0, 256, (4 + k % 3) * 5).astype(np.uint8).tobytes()) for k in range(20)] + [("s0", 7_000, 4, 5, None)]
    return rows, spark.createDataFrame(rows, "seq string, k int, height int, width int, pixels binary").repartition(3)


def test_describe_frames_of_differing_sizes(spark):
    rows, df = frames(spark)
    model = inference.tiny_describer()
    got = {r["k"]: r["vec"] for r in inference.describe(df, inference.tiny_describer, "t", together=2).collect()}
    assert got.pop(7_000) is None
    for _, k, h, w, raw in rows[:-1]:
        want = model(np.frombuffer(raw, np.uint8).reshape(1, h, w))[0]
        assert got[k] == pytest.approx(want.tolist())
    assert inference.describe(df.limit(0), inference.tiny_describer, "t").count() == 0


def test_state_stays_within_a_sequence(spark):
    rows, df = frames(spark)
    same = [r for r in rows if r[4] is not None and r[2] == 4] + [rows[-1], ("s0", 4, 4, 5, bytes(20))]
    df = spark.createDataFrame(same, df.schema).repartition(3)
    got = {r["k"]: r["out"] for r in inference.reconstruct(df, "seq", ["k"], inference.tiny_reconstructor, "u").collect()}
    for seq in ("s0", "s1"):
        model, state = inference.tiny_reconstructor(), None
        for _, k, h, w, raw in sorted((r for r in same if r[0] == seq), key=lambda r: r[1]):
            if raw is None:
                assert got[k] is None
                continue
            image, state = model(np.frombuffer(raw, np.uint8).reshape(h, w), state)
            assert bytes(got[k]) == image.astype(np.uint8).tobytes()


# ------------------------------------------------------------ search
def test_search_keeps_what_a_loop_keeps(spark):
    table = search.trials(spark, 30, {"a": (0, 9), "b": (0.0, 1.0), "c": ["x", "y"]}, seed=3)
    rows = table.collect()
    assert {r["a"] for r in rows} <= set(range(10)) and all(0 <= r["b"] < 1 for r in rows) and {r["c"] for r in rows} == {"x", "y"}
    assert [tuple(r) for r in search.trials(spark, 30, {"a": (0, 9), "b": (0.0, 1.0), "c": ["x", "y"]}, seed=3).collect()] == [tuple(r) for r in rows]
    value = lambda r, step: None if r["a"] == 4 and step == 2 else r["b"] * step - abs(r["a"] - 5)
    calls = []

    def evaluate(live, step):
        calls.append(live.count())
        v = F.col("b") * step - F.abs(F.col("a") - 5)
        return live.select("trial", (F.when(F.col("a") != 4, v) if step == 2 else v).alias("value"))

    got = {r["trial"]: (r["rounds"], r["state"], r["value"], r["place"]) for r in search.search(table, [1, 2, 3, 4], evaluate, warmup=2).collect()}
    live, want = {r["trial"]: (r, 0.0) for r in rows}, {}
    for k, step in enumerate([1, 2, 3, 4], 1):
        assert calls[k - 1] == len(live)
        for t, (r, total) in list(live.items()):
            v = value(r, step)
            if v is None:
                want[t] = (k, "failed", None)
                del live[t]
            else:
                live[t] = (r, total + v)
        middle = np.median([x for _, x in live.values()])
        if 2 <= k < 4 and len(live) >= 4:
            for t, (_, total) in list(live.items()):
                if total < middle:
                    want[t] = (k, "pruned", total / k)
                    del live[t]
    ranked = sorted(live, key=lambda t: (-live[t][1], t))
    want |= {t: (4, "complete", live[t][1] / 4) for t in live}
    assert got.keys() == want.keys()
    for t, (k, state, v) in want.items():
        assert got[t][:2] == (k, state) and (got[t][2] == pytest.approx(v) if v is not None else got[t][2] is None)
        assert got[t][3] == (ranked.index(t) + 1 if t in live else None)


def test_search_without_trials(spark):
    none = spark.createDataFrame([], "trial long, a int")
    assert search.search(none, [1, 2], lambda live, s: live.select("trial", F.col("a").alias("value"))).count() == 0


# ------------------------------------------------------------ moves, overlays
def test_moves(spark, tmp_path):
    for name in ("a", "b", "c", "d/e", "there"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    plan = [("a", "new/a"), ("b", "there"), ("gone", "new/g"), ("c", "same"), ("d/e", "same"), ("../x", "y"), ("there", "../z"), (None, "n"), ("a", "new/a")]
    df = spark.createDataFrame(plan, "old string, new string")
    assert sorted(map(tuple, artefacts.move(df, str(tmp_path)).collect())) == [("../x", "y", "clash"), ("a", "new/a", "moved"), ("b", "there", "kept"), ("c", "same", "moved"), ("d/e", "same", "clash"), ("gone", "new/g", "missing"), ("there", "../z", "clash")]
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"new/a": "a", "b": "b", "same": "c", "d/e": "d/e", "there": "there"}
    again = {r["old"]: r["state"] for r in artefacts.move(df, str(tmp_path)).collect()}
    assert again["a"] == "missing" and again["b"] == "kept" and again["d/e"] == "kept"


def test_overlay_of_tables(spark):
    explicit = spark.createDataFrame([(1, "x", None, 0), (2, "y", 5.0, None)], "id int, kind string, res double, flag int")
    defaults = spark.createDataFrame([("x", 1.5, 1, 7), ("y", 2.5, 1, 8)], "kind string, res double, flag int, extra int")
    assert sorted(map(tuple, readers.overlay_table(explicit, defaults, "kind", ("flag",)).collect())) == [(1, "x", 1.5, False, 7), (2, "y", 5.0, True, 8)]
    with pytest.raises(ValueError, match="unknown dataset type: y"):
        readers.overlay_table(explicit, defaults.where("kind = 'x'"), "kind")


def test_counts_above_marks_meet_no_pairs(spark, monkeypatch):
    import re

    from eventloom import catalog
    from eventloom.operators import ranks

    from .conftest import SF

    v = spark.createDataFrame([(0.0,)] * 50 + [(1.0,), (2.0,), (2.0,), (None,)], "x double")
    m = spark.createDataFrame([(-1.0,), (0.0,), (0.0,), (1.5,), (2.0,), (9.0,), (None,)], "y double")
    assert sorted(map(tuple, ranks.count_above(v, "x", m, "y").collect())) == [(-1.0, 53), (0.0, 3), (1.5, 2), (2.0, 0), (9.0, 0)]
    assert sorted(map(tuple, ranks.count_above(v.limit(0), "x", m, "y").collect())) == [(-1.0, 0), (0.0, 0), (1.5, 0), (2.0, 0), (9.0, 0)]
    plans = []

    def spy(table, steps, evaluate):
        plans.append(evaluate(table, steps[0])._jdf.queryExecution().toString())
        return table.selectExpr("trial", "1 AS rounds", "'' AS state", "0.0D AS value", "1L AS place")

    monkeypatch.setattr(search, "search", spy)
    catalog.QUERIES["r22_search"](spark, SF).collect()
    assert not re.search(r"NestedLoopJoin \w+, \w+, \(", plans[0])
