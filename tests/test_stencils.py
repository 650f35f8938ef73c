"""Neighbourhoods over tiles against plain loops over whole frames."""

import math

import numpy as np
import pytest

from eventloom.operators import stencils as S

H, W = 23, 17


def frames():
    r = np.random.default_rng(3)
    blob = np.zeros((H, W))
    blob[4:9, 5:12], blob[15:20, 2:4], blob[0, 0], blob[22, 16] = 9, 5, 3, 8
    return {"noise": r.integers(0, 200, (H, W)).astype(float), "blob": blob, "flat": np.full((H, W), 4.0), "dots": (r.random((H, W)) < 0.1) * 7.0}


def sparse(spark, fill=0.0):
    rows = [(k, y, x, float(f[y, x])) for k, f in frames().items() for y in range(H) for x in range(W) if f[y, x] != fill]
    rows += [("noise", -1, 3, 5.0), ("noise", 3, 99, 5.0), ("blob", 5, 6, None), ("blob", 5, 6, 1.0)]  # off the frame, null, lower than the other
    return spark.createDataFrame(rows, "k string, y int, x int, v double").repartition(3)


def images(df):
    out = {}
    for r in df.collect():
        f = out.setdefault(r["k"], np.full((H, W), np.nan))
        assert np.isnan(f[r["y"], r["x"]])
        f[r["y"], r["x"]] = r["v"]
    return out


def mirrored(f, y, x):
    return f[abs(y) if y < H else 2 * H - 2 - y, abs(x) if x < W else 2 * W - 2 - x]


@pytest.mark.parametrize("tile", [5, 8, 128])
def test_unsharp(spark, tile):
    got, w = images(S.unsharp(sparse(spark), ["k"], H, W, 0.4, 1.0, tile=tile)), S.gaussian(5, 1.0)
    assert sum(w) == pytest.approx(1) and w == pytest.approx(w[::-1])
    for k, f in frames().items():
        p = np.pad(f, 2)
        mean = sum(w[a] * w[b] * p[a : a + H, b : b + W] for a in range(5) for b in range(5))
        assert np.allclose(got[k], 1.4 * f - 0.4 * mean)


@pytest.mark.parametrize("tile", [5, 128])
def test_bilateral(spark, tile):
    got = images(S.bilateral(sparse(spark, 4.0), ["k"], H, W, 0.3, fill=4.0, tile=tile))
    for k, f in frames().items():
        if k == "flat":
            assert k not in got  # no row has a pixel of it
            continue
        want = np.zeros((H, W))
        for y in range(H):
            for x in range(W):
                total = weight = 0.0
                for dy in range(-2, 3):
                    for dx in range(-2, 3):
                        if dy * dy + dx * dx <= 4:
                            v = mirrored(f, y + dy, x + dx)
                            e = math.exp(-(dy * dy + dx * dx) / (2 * 7.5**2) - (v - f[y, x]) ** 2 / (2 * 7.5**2))
                            total, weight = total + e * v, weight + e
                want[y, x] = total / weight
        assert np.allclose(got[k], want)


def brute_features(f):
    most = f.max()
    b = np.floor(f / most * 255) if most > 0 else np.zeros_like(f)
    g = lambda y, x: mirrored(b, y, x)
    gx, gy = np.zeros((H, W)), np.zeros((H, W))
    for y in range(H):
        for x in range(W):
            gx[y, x] = sum(s * (g(y + d, x + 1) - g(y + d, x - 1)) for d, s in ((-1, 1), (0, 2), (1, 1)))
            gy[y, x] = sum(s * (g(y + 1, x + d) - g(y - 1, x + d)) for d, s in ((-1, 1), (0, 2), (1, 1)))
    size = np.hypot(gx, gy)
    turn = np.histogram(np.arctan2(gy, gx), bins=8, range=(-np.pi, np.pi))[0] / size.size
    r = np.zeros((H, W))
    for y in range(H):
        for x in range(W):
            a, c, e = (sum(mirrored(p, y + dy, x + dx) for dy in (-1, 0) for dx in (-1, 0)) for p in (gx * gx / 64, gx * gy / 64, gy * gy / 64))
            r[y, x] = a * e - c * c - 0.04 * (a + e) ** 2
    score = np.zeros((H, W))
    for y in range(3, H - 3):
        for x in range(3, W - 3):
            ring = [b[y + dy, x + dx] - b[y, x] for dy, dx in S.CIRCLE] * 2
            best = max(max(min(ring[k : k + 9]), -max(ring[k : k + 9])) for k in range(16))
            score[y, x] = best if best > 10 else 0
    p = np.pad(score, 1)
    fast = sum(score[y, x] > 0 and all(score[y, x] > p[y + 1 + dy, x + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx) for y in range(H) for x in range(W))
    return ((size > 10).mean(), size.mean(), turn.max() - turn.min() if (size > 0).any() else 0, r.mean(), r.max(), fast)


@pytest.mark.parametrize("tile, fill", [(7, 0.0), (128, 0.0), (9, 4.0)])
def test_edge_features(spark, tile, fill):
    rows = S.edge_features(sparse(spark, fill), ["k"], H, W, fill=fill, tile=tile).collect()
    want = {k: brute_features(f) for k, f in frames().items() if fill == 0 or k != "flat"}
    assert {r["k"] for r in rows} == set(want)
    for r in rows:
        assert list(r)[1:] == pytest.approx(want[r["k"]], rel=1e-9, abs=1e-6), r["k"]
    assert want["noise"][5] > 0


def test_octants_agree_with_angles():
    gx, gy = (a.ravel().astype(float) for a in np.mgrid[-40:41, -40:41])
    k = np.array([np.histogram([a], bins=8, range=(-np.pi, np.pi))[0].argmax() for a in np.arctan2(gy, gx)])
    assert np.array_equal(S.octant(gx, gy), k)


def test_small_frames_and_none(spark):
    with pytest.raises(ValueError):
        S.bilateral(sparse(spark), ["k"], 2, 2, 1.0)
    assert S.unsharp(sparse(spark).limit(0), ["k"], H, W, 1.0, 1.0).count() == 0
    one = spark.createDataFrame([("a", 0, 0, 2.0)], "k string, y int, x int, v double")
    assert [r["v"] for r in S.unsharp(one, ["k"], 1, 1, 0.0, 1.0).collect()] == [2.0]
