"""Hand-made edge cases and dense NumPy twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.operators import analytics, binning, ensemble, joins, metrics, recon, seqmatch, similarity, trajectory
from eventloom.sources import readers

from .conftest import SF

EV = "seq string, event_id long, t double, x int, y int, p int"


def ev(spark, *rows):
    return spark.createDataFrame([("s", i, float(t), x, y, p) for i, (t, x, y, p) in enumerate(rows)], EV).withColumn("bin_id", F.lit(0))


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_event_on_edge_is_in_both_bins(spark):
    e = ev(spark, (0, 0, 0, 1), (1, 0, 0, 1), (2.5, 0, 0, 1)).drop("bin_id")
    b = spark.createDataFrame([("s", 0.0, 2.5)], "seq string, t_first double, t_last double")
    n = binning.assign_time_bins(e, b, 1.0).groupBy("bin_id").count()
    assert got(n, "bin_id", "count") == [(0, 2), (1, 1)]
    bins = binning.time_bins(b, 1.0)
    assert got(bins, "bin_id", "t0", "t1") == [(0, 0.0, 1.0), (1, 1.0, 2.0)]
    assert got(binning.interval_join(e, bins, 1.0).groupBy("bin_id").count(), "bin_id", "count") == [(0, 2), (1, 1)]


def test_no_room_for_a_bin(spark):
    b = spark.createDataFrame([("s", 0.0, 0.5)], "seq string, t_first double, t_last double")
    assert binning.time_bins(b, 1.0).count() == 0


def test_count_bins(spark):
    e = ev(spark, *[(i * 1.7, 0, 0, 1) for i in range(7)]).drop("bin_id")
    n = binning.count_bins(e, 3, 2.0).groupBy("bin_id").count()
    assert got(n, "bin_id", "count") == [(0, 3), (1, 3), (2, 1)]


def test_histogram_of_one_pixel(spark):
    e = ev(spark, (0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1), (4, 9, 0, 1))
    assert got(recon.polarity_histogram(e, 2, 2), "channel", "v") == [("G", 254), ("R", 254)]


def test_minus_one_counts_as_on(spark):
    assert got(recon.polarity_histogram(ev(spark, (0, 0, 0, -1)), 2, 2), "channel") == [("G",)]


def test_count_image_background(spark):
    assert got(recon.count_image(ev(spark, (0, 1, 0, 1)), 2, 2), "x", "y", "v") == [(1, 0, 224)]


def test_surface_channels_are_swapped(spark):
    s = recon.time_surface(ev(spark, (0, 0, 0, 1), (0.05, 1, 0, 0)), 2, 2)
    assert got(s, "channel", "x") == [("G", 1), ("R", 0)]


def test_transitions(spark):
    t = recon.transition_counts(ev(spark, (0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 0)))
    assert got(t, "off_on", "on_off", "same") == [(1, 1, 1)]


def test_voxel_split(spark):
    v = recon.voxel_grid(ev(spark, (0, 0, 0, 1), (0.5, 1, 0, 1), (1, 2, 0, 1)), 2)
    assert got(v.where("x = 1"), "ti", "v") == [(0, 0.5), (1, 0.5)]


def track(spark, xy, dt=1.0):
    return spark.createDataFrame([("s", i, i * dt, float(a), float(b)) for i, (a, b) in enumerate(xy)], "seq string, idx int, t double, e double, n double")


def test_stationary(spark):
    m = trajectory.speeds(trajectory.angular_velocity(trajectory.headings(track(spark, [(1, 1)] * 5)), 2))
    m = m.withColumn("ang_acc", F.lit(0.0)).withColumn("lin_acc", F.lit(0.0))
    assert got(trajectory.adaptive_size(m), "heading", "speed", "size") == [(0.0, 0.0, 20.0)] * 5


def test_slope_is_that_of_polyfit(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=15)
    m = track(spark, [(a, 0) for a in v])
    s = [r["k"] for r in trajectory.slopes(m, {"e": "k"}, 6).orderBy("idx").collect()]
    for i in range(15):
        a, b = max(0, i - 3), min(15, i + 4)
        assert s[i] == pytest.approx(np.polyfit(np.arange(a, b) - i, v[a:b], 2)[-2], abs=1e-9)


def test_radius_edge(spark):
    q = spark.createDataFrame([(0, 0.0, 0.0)], "q int, qe double, qn double")
    r = spark.createDataFrame([(1, 25.0, 0.0), (2, 25.1, 0.0)], "r int, re double, rn double")
    assert got(joins.radius_join(q, r, 25.0), "r") == [(1,)]
    assert got(joins.radius_join(q, r, 25.0, inclusive=False), "r") == []


def test_argmax_takes_first_of_ties(spark):
    s = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 0, 0.5)], "q int, r int, s double")
    assert got(similarity.top1(s), "q", "r") == [(0, 1)]


def test_two_recalls(spark):
    best = spark.createDataFrame([(0, 3, 1.0), (1, 4, 1.0)], "q int, r int, s double")
    pos = spark.createDataFrame([(0, 3)], "q int, r int")
    assert metrics.recall_at_1(best, pos).head()["recall_at_1"] == 1.0
    assert metrics.recall_at_1(best, pos, denominator="all").head()["recall_at_1"] == 0.5


def test_constant_scores(spark):
    best = spark.createDataFrame([(0, 3, 1.0), (1, 4, 1.0)], "q int, r int, s double")
    pos = spark.createDataFrame([(0, 3)], "q int, r int")
    c = metrics.pr_curve(best, pos)
    assert got(c, "k", "precision", "recall") == [(0, 0.0, 0.0)]
    assert metrics.auc(c).head()["auc"] == 0.0


def sim_table(spark, m):
    return spark.createDataFrame([("a", q, r, float(m[q, r])) for q in range(m.shape[0]) for r in range(m.shape[1])], "run string, q int, r int, s double")


def dense_modified(m, length, guard):
    out = np.zeros_like(m)
    for q in range(len(m)):
        w = m[max(0, q - length + 1) : q + 1]
        sd = w.std(axis=0) + 1e-8
        if guard:
            sd[sd < 1e-4] = 1.0
        c = (w - w.mean(axis=0)) / sd
        z = (c - c.mean(axis=1, keepdims=True)) / (c.std(axis=1, keepdims=True) + 1e-8)
        for j in range(m.shape[1]):
            out[q, j] = sum(z[-1 - k, j - k] for k in range(min(len(w), j + 1)))
    return out


@pytest.mark.parametrize("guard", [True, False])
def test_modified_matches_dense(spark, guard):
    m = np.random.default_rng(1).normal(size=(7, 9))
    g = {(r["q"], r["r"]): r["s"] for r in seqmatch.modified(sim_table(spark, m), 3, guard).collect()}
    want = dense_modified(m, 3, guard)
    for q in range(1, 7):
        for r in range(9):
            assert g[q, r] == pytest.approx(want[q, r], abs=1e-6)
    if guard:
        assert all(g[0, r] == 0 for r in range(9))


def test_first_row_is_zero_and_length_one_identity(spark):
    m = np.eye(6)
    s = seqmatch.modified(sim_table(spark, m), 3)
    assert got(similarity.top1(s, "run"), "q", "r")[0] == (0, 0)
    one = seqmatch.modified(sim_table(spark, m), 1)
    assert got(one.where("s = 1"), "q", "r") == [(i, i) for i in range(6)]


def test_seqslam_rows_out_of_reach(spark):
    m = np.random.default_rng(2).normal(size=(5, 12))
    s = seqmatch.seqslam(sim_table(spark, m), 3, (1.0,), size=3)
    assert s.where("q < 2 and s > -1e300").count() == 0
    assert s.where("q >= 2 and r >= 2 and s < -1e300").count() == 0


def test_fusion_of_equal_members(spark):
    m = sim_table(spark, np.arange(6.0).reshape(2, 3))
    three = m.unionByName(m.withColumn("run", F.lit("b"))).unionByName(m.withColumn("run", F.lit("c")))
    assert all(r["mean"] == r["max"] == r["median"] for r in ensemble.fuse(three).collect())
    assert ensemble.disagreement(three).head()["avg_disagreement"] == 0
    assert ensemble.disagreement(m).head()["avg_disagreement"] == 0


def test_missing_member_aborts_only_for_all(spark):
    av = spark.createDataFrame([("x", "a", "l2")], "run string, recon string, vpr string")
    axes = {"recon": ["a", "b"], "vpr": ["l2"]}
    assert ensemble.select_members(av, axes, "recon", {"vpr": "l2"}).count() == 1
    with pytest.raises(LookupError):
        ensemble.select_members(av, axes, "all", {})


def test_nmea_filter_compares_with_last_accepted(spark):
    step = 0.6e-5  # about 0.7 m in latitude
    rows = [("s", i, 10 + step * i, 20 + step * i) for i in range(6)]
    p = spark.createDataFrame(rows, "seq string, idx int, lat double, lon double")
    kept = [r["idx"] for r in trajectory.nmea_filter(p, 1.0).orderBy("idx").collect()]
    assert kept == [0, 2, 4]


def test_student_t():
    assert analytics.student_t_two_sided(2.0, 10.0) == pytest.approx(0.07338803477, abs=1e-9)
    assert analytics.student_t_two_sided(0.0, 5.0) == 1.0


def test_unknown_configuration():
    with pytest.raises(ValueError):
        readers.overlay({}, {"a": {}}, "b")


def test_min_gap_fold_over_several_sequences(spark):
    rows = [(s, i, float(i)) for s in ("a", "b") for i in range(7)]
    df = spark.createDataFrame(rows, "seq string, event_id long, t double")
    assert got(binning.min_gap_sample(df, 3.0), "seq", "t") == [(s, t) for s in ("a", "b") for t in (0.0, 3.0, 6.0)]


def test_adaptive_bins_cover_each_sequence(spark):
    rows = [(s, i, float(i), 4.0) for s in ("a", "b") for i in range(10)]
    b = binning.adaptive_bins(spark.createDataFrame(rows, "seq string, idx int, t double, size double"))
    assert got(b.where("seq = 'b'"), "bin_id", "t0", "t1") == [(0, 0.0, 4.0), (1, 4.0, 8.0), (2, 8.0, 9.0)]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("rows, columns", [(3, 4), (5, 7), (1, 30), (40, 1)])
def test_tiles_of_any_size_match_alike(spark, monkeypatch, rows, columns):
    """Two runs of differing size, scores that tie and a constant column; tiles of a few cells against one tile."""
    r = np.random.default_rng(2)
    tables = [np.round(r.normal(size=(17, 23)), 1), np.round(r.normal(size=(6, 30)), 1)]
    tables[0][:, 4] = 1.0
    cells = [(f"m{k}", q, j, float(m[q, j])) for k, m in enumerate(tables) for q in range(m.shape[0]) for j in range(m.shape[1])]
    sim = spark.createDataFrame(cells, "run string, q int, r int, s double").repartition(3)
    ways = {
        "modified": lambda s: seqmatch.modified(s, 4),
        "plain": lambda s: seqmatch.modified(s, 3, guard=False, divide=True),
        "contrast": lambda s: seqmatch.contrast(s, 5),
        "seqslam": lambda s: seqmatch.seqslam(s, 4, (0.8, 1.0, 1.3)),
        "row": lambda s: seqmatch.legacy(s, 3),
        "column": lambda s: seqmatch.legacy(s, 3, axis="column"),
    }
    read = lambda df: {(x["run"], x["q"], x["r"]): x["s"] for x in df.collect()}
    whole = {k: read(f(sim)) for k, f in ways.items()}
    monkeypatch.setattr(seqmatch, "ROWS", rows)
    monkeypatch.setattr(seqmatch, "COLUMNS", columns)
    for k, f in ways.items():
        got = read(f(sim))
        assert got.keys() == whole[k].keys() and len(got) == len(cells)
        for c, v in whole[k].items():
            assert got[c] == pytest.approx(v, rel=1e-9, abs=1e-7), (k, c)


def test_matching_of_nothing(spark):
    none = spark.createDataFrame([], "run string, q int, r int, s double")
    assert seqmatch.modified(none, 3).count() == seqmatch.seqslam(none, 3).count() == seqmatch.legacy(none, 3).count() == 0


def test_score_runs_meet_by_run_and_patch(spark):
    q = spark.createDataFrame([("a", 0, 0, [1.0, 0.0]), ("a", 1, 0, [0.0, 2.0]), ("b", 0, 1, [3.0, 4.0])], "run string, idx int, patch int, vec array<double>")
    got = {(r["metric"], r["run"], r["patch"], r["q"], r["r"]): r["s"] for r in similarity.score_runs(q, q, ("l2", "sad", "cosine"), block=1).collect()}
    assert len(got) == 15 and got["l2", "a", 0, 0, 1] == -5 and got["sad", "a", 0, 0, 1] == -3 and got["cosine", "b", 1, 0, 0] == pytest.approx(1)


def test_asof_ties_go_by_value(spark):
    """Of 9, 10 and -3 at one time the largest holds, and null only where nothing else is."""
    left = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 0.5)], "seq string, t double")
    right = spark.createDataFrame([("a", 1.0, v) for v in (9, 10, None, -3)] + [("b", 1.0, None), ("c", 1.0, 7), ("c", 1.0, 70), ("c", 1.0, 8)], "seq string, t double, v int")
    assert got(joins.asof(left, right, "seq", "t", ["v"], 10.0), "seq", "prev_v")[0] == ("a", 10)
    assert {(r["seq"], r["prev_v"], r["prev_t"]) for r in joins.asof(left, right, "seq", "t", ["v"], 10.0).collect()} == {("a", 10, 1.0), ("b", None, 1.0), ("c", None, None)}
    ahead = joins.asof(left, right, "seq", "t", ["v"], 10.0, "forward", "next_")
    assert {(r["seq"], r["next_v"]) for r in ahead.collect()} == {("a", None), ("b", None), ("c", 70)}


def test_nearest_place_grows_its_cells(spark):
    r = np.random.default_rng(5)
    b = np.concatenate([r.normal(0, 1, (300, 2)), [[1000, 1000], [1000, 1000], [0.5, 0.5]]])
    a = np.concatenate([r.normal(0, 5, (100, 2)), [[999, 1002], [-5000, 40], [0.5, 0.5]]])
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)] + [(900, float("nan"), 0.0), (901, None, 1.0)], "q int, qe double, qn double")
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)] + [(900, float("inf"), 0.0)], "r int, re double, rn double")
    near = joins.nearest_place(left, right)
    for q, k, d in got(near, "q", "r", "dist"):
        all_d = np.sqrt(((b - a[q]) ** 2).sum(1))
        assert k == all_d.argmin() and d == pytest.approx(all_d.min())
    assert near.count() == len(a)
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert joins.nearest_place(left, right.limit(0)).count() == 0 and joins.nearest_place(left.limit(0), right).count() == 0
    one = spark.createDataFrame([(1, 2.0, 2.0)], "r int, re double, rn double")
    assert got(joins.nearest_place(left.where("q < 3"), one), "q", "r") == [(0, 1), (1, 1), (2, 1)]


def test_slopes_over_stretches(spark):
    """Stretches of a few rows fit as one does; short sequences, a null value, rows of one time."""
    r = np.random.default_rng(9)
    rows = [("a", k, float(t), float(v), 1.0) for k, (t, v) in enumerate(zip(np.sort(r.uniform(0, 50, 40)), r.normal(size=40)))]
    rows += [("b", 0, 1.0, 2.0, 1.0), ("b", 1, 2.0, 4.0, 1.0)] + [("c", k, 3.0, float(k), 1.0) for k in range(5)] + [("d", k, float(k), None if k == 6 else 2.0 * k, 1.0) for k in range(12)]
    track = spark.createDataFrame(rows, "seq string, idx int, t double, v double, w double").repartition(3)
    read = lambda df: {(x["seq"], x["idx"]): (x["dv"], x["dw"]) for x in df.collect()}
    whole = read(trajectory.slopes(track, {"v": "dv", "w": "dw"}, 6))
    assert len(whole) == len(rows) and whole["b", 0] == (0, 0) and whole["c", 2][0] == 0
    assert [k for k in range(12) if whole["d", k][0] is None] == list(range(3, 10)) and whole["d", 0][0] == pytest.approx(2)
    for span in (3, 7):
        got_ = read(trajectory.slopes(track, {"v": "dv", "w": "dw"}, 6, span))
        assert got_.keys() == whole.keys()
        for k, (v, w) in whole.items():
            assert (got_[k][0] is None) == (v is None) and got_[k][1] == pytest.approx(w, abs=1e-9) and (v is None or got_[k][0] == pytest.approx(v))
    t, v = np.array([x[2] for x in rows[:40]]), np.array([x[3] for x in rows[:40]])
    for k in range(40):
        near = slice(max(0, k - 3), k + 4)
        assert whole["a", k][0] == pytest.approx(np.polyfit(t[near] - t[k], v[near], 2)[1], rel=1e-6, abs=1e-8)


def test_tour_with_cells_is_the_plain_one():
    r = np.random.default_rng(4)
    for xy in (r.uniform(0, 100, (300, 2)), np.round(r.normal(0, 2, (200, 2))), np.zeros((5, 2)), np.array([[0.0, 0], [1e6, 1], [1, 0], [1e6, 2], [2, 0]]), np.cumsum(r.normal(size=(400, 2)), 0), r.uniform(0, 1, (1, 2))):
        left, order, at = set(range(1, len(xy))), [0], 0
        while left:
            at = min(left, key=lambda k: (np.sqrt(((xy[k] - xy[at]) ** 2).sum()), k))  # noqa: B023
            left.remove(at)
            order.append(at)
        assert trajectory._tour(xy).tolist() == order


def test_curves_of_several_runs(spark):
    """Each run has its own thresholds; a run of one score has the point (0, 0)."""
    best = spark.createDataFrame([("a", q, q, float(q)) for q in range(6)] + [("b", q, q, 5.0 - q) for q in range(6)] + [("c", q, q, 1.0) for q in range(6)], "run string, q int, r int, s double")
    pos = spark.createDataFrame([(q, q if q < 3 else 99) for q in range(6)], "q int, r int")
    both = metrics.pr_curve(best, pos, "run")
    for run in "abc":
        alone = metrics.pr_curve(best.where(F.col("run") == run), pos)
        assert got(both.where(F.col("run") == run), "k", "precision", "recall") == got(alone, "k", "precision", "recall")
    areas = dict(got(metrics.auc(both, "run"), "run", "auc"))
    assert areas["c"] == 0 and areas["b"] > areas["a"]


def test_tick_counts_meet_no_events(spark, monkeypatch):
    """Equal times, a window that starts on an event, ticks without events before them; events are counted, not joined to ticks."""
    rows = [("a", k, t) for k, t in enumerate((0.0, 1.0, 1.0, 2.5, 4.0, 4.0, 9.0))] + [("b", 7, 3.0)]
    e = spark.createDataFrame(rows, "seq string, event_id long, t double")
    ticks = e.select("seq", F.col("event_id").alias("tick_id"), F.col("t").alias("tick_t"))
    want = got(binning.tick_windows(e, ticks, 3.0).groupBy("seq", "tick_id").count(), "seq", "tick_id", "count")
    monkeypatch.setattr(binning, "interval_join", None)
    for bucket in (0.7, 100.0):
        assert got(binning.tick_counts(e, ticks, 3.0, bucket), "seq", "tick_id", "n") == want
    assert catalog.QUERIES["w12_tick_windows"](spark, SF).head(1)


def test_accelerations_of_rows_at_equal_times(spark, tmp_path):
    """Events that occur three times at one time: fits of one or two times have no one answer, and the SQL's is to come out."""
    import duckdb

    e = spark.read.parquet(f"{SF}/events.parquet")
    copies = [e.withColumn("event_id", F.col("event_id") + 1000 * k) for k in range(3)]
    copies[0].unionByName(copies[1]).unionByName(copies[2]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.SQL["o7_acceleration"]).fetchall()
    out = catalog.QUERIES["o7_acceleration"](spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in out.select("seq", "idx", "lin_acc").collect()) == sorted(repr(tuple(r[:3])) for r in want)


def test_tour_holds_few_bytes_a_point():
    import tracemalloc

    xy = np.random.default_rng(1).normal(size=(4000, 2))
    tracemalloc.start()
    order = trajectory._tour(xy)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(4000)) and peak < 250 * 4000


def test_angular_velocity_and_acceleration_where_rows_share_times(spark, tmp_path):
    """20 rows at each time: turns of nothing by no time, of which the last bits decide the sign. The SQL runs over each sequence alone."""
    import duckdb

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.crossJoin(spark.range(20).withColumnRenamed("id", "k")).withColumn("event_id", F.col("event_id") + 1_000_000 * F.col("k")).drop("k").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("o5_angular_velocity", "o7_acceleration"):
        rows = lambda df: sorted(tuple(map(repr, x)) for x in df[sorted(df.columns)].astype({c: float for c in df.columns if c != "seq"}).itertuples(index=False, name=None))
        got, want = rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), []
        for k in range(8):
            con = duckdb.connect()
            con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE user_id % 8 = {k}")
            want += rows(con.sql(catalog.SQL[name]).df())
        assert got == sorted(want)
