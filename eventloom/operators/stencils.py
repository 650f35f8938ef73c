"""Two-dimensional neighbourhoods over frames of sparse pixels.

Frames are cut into tiles. A pixel goes to its own tile and, near an edge, to the up to three others whose halo it lies
in, so that one shuffle by (frame, tile) brings every neighbourhood together; a tile is then worked on as an array. The
result is dense, one row per pixel of each frame that has a pixel on it, or one row of sums per tile.

Pixels that no row touches hold ``fill``. Of two rows for one pixel the larger value counts; null values and pixels off the frame
are left out. Frames of any size take memory for one tile. Beyond the frame lie zeros, or its mirror image without the edge itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


class Tile:
    """A tile with its halo: ``data``; the place of its first pixel, the frame's size, and whether it is at the frame's top and left."""

    def __init__(self, data: np.ndarray, halo: int, y: int, x: int, height: int, width: int):
        self.data, self.halo, self.y, self.x, self.height, self.width = data, halo, y, x, height, width

    @property
    def shape(self) -> tuple[int, int]:
        return self.data.shape[0] - 2 * self.halo, self.data.shape[1] - 2 * self.halo

    def shifted(self, dy: int, dx: int, grown: int = 0) -> np.ndarray:
        """The tile, or one ``grown`` by that many pixels on every side, moved by (dy, dx)."""
        h, w = self.shape
        a = self.halo - grown
        return self.data[a + dy : a + dy + h + 2 * grown, a + dx : a + dx + w + 2 * grown]


def _tiles(pixels: DataFrame, keys: list[str], height: int, width: int, halo: int, tile: int) -> DataFrame:
    """(keys, ty, tx, y, x, v): pixels with each tile that needs them, and one row without a pixel for every tile of a frame."""
    near = lambda c, size: F.array_distinct(F.transform(F.array(c - halo, c, c + halo), lambda k: F.floor(F.greatest(F.lit(0), F.least(k, F.lit(size - 1))) / tile).cast("int")))
    own = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & F.col("v").isNotNull()).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    spread = own.withColumn("ty", F.explode(near(F.col("y"), height))).withColumn("tx", F.explode(near(F.col("x"), width)))
    grid = [(-(-n // tile)) - 1 for n in (height, width)]
    every = own.select(*keys).distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(grid[0])))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(grid[1]))))
    none = every.select(*keys, F.lit(-1).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("v"), "ty", "tx")
    return spread.unionByName(none)


def over_tiles(pixels: DataFrame, keys: list[str], height: int, width: int, halo: int, work: Callable[[Tile], dict[str, np.ndarray]], out: str, fill: float = 0.0, border: str = "mirror", tile: int = TILE) -> DataFrame:
    """Rows (keys, *out) of what ``work`` makes of each tile: columns of equal length. ``border``: ``mirror`` or ``zero``."""
    if border == "mirror" and min(height, width) <= halo:
        raise ValueError("a frame is to be larger than the halo")
    fields = [f.split() for f in out.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y, x, v = (table.column(c).to_numpy() for c in "yxv")
        y0, x0 = ty * tile, tx * tile
        y1, x1 = min(height, y0 + tile), min(width, x0 + tile)
        # what of the tile and its halo lies on the frame
        a, b, c, d = max(0, y0 - halo), min(height, y1 + halo), max(0, x0 - halo), min(width, x1 + halo)
        inside = np.full((b - a, d - c), -np.inf)
        at = (y >= a) & (y < b) & (x >= c) & (x < d)
        np.maximum.at(inside, (y[at] - a, x[at] - c), v[at])
        inside[inside == -np.inf] = fill
        pads = ((halo - (y0 - a), halo - (b - y1)), (halo - (x0 - c), halo - (d - x1)))
        data = np.pad(inside, pads, mode="reflect") if border == "mirror" else np.pad(inside, pads)
        made = work(Tile(data, halo, y0, x0, height, width))
        n = len(next(iter(made.values())))
        key = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys]
        return pa.table([*key, *(pa.array(made[name], arrow[kind]) for name, kind in fields)], names=[*keys, *(name for name, _ in fields)])

    kinds = dict(pixels.dtypes)
    cut = _tiles(pixels, keys, height, width, halo, tile)
    return cut.groupBy(*keys, "ty", "tx").applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), out]))


def _pixels(t: Tile, value: np.ndarray) -> dict[str, np.ndarray]:
    y, x = np.mgrid[: value.shape[0], : value.shape[1]]
    return {"y": (y + t.y).ravel(), "x": (x + t.x).ravel(), "v": value.ravel()}


# ------------------------------------------------------------ filters
def gaussian(size: int, sigma: float) -> list[float]:
    """Weights along one axis, in all 1: the roots of the normal probabilities of ``size`` equal parts of
    the stretch of 2 sigma and one part around zero (a product of two is the weight of a pixel)."""
    part = (2 * sigma + 1.0) / size
    cuts = [-sigma - part / 2 + k * (2 * sigma + part) / size for k in range(size + 1)]
    below = [0.5 * (1 + math.erf(c / math.sqrt(2))) for c in cuts]
    roots = [math.sqrt(b - a) for a, b in zip(below, below[1:])]
    return [r / sum(roots) for r in roots]


def unsharp(pixels: DataFrame, keys: list[str], height: int, width: int, amount: float, sigma: float, fill: float = 0.0, tile: int = TILE) -> DataFrame:
    """(keys, y, x, v): each pixel (1 + amount) times, less amount times its Gaussian mean over 5 x 5 pixels, zeros beyond the frame."""
    w = gaussian(5, sigma)

    def work(t: Tile) -> dict[str, np.ndarray]:
        down = sum(w[k] * t.data[k : k + t.shape[0]] for k in range(5))  # first along one axis, then the other
        mean = sum(w[k] * down[:, k : k + t.shape[1]] for k in range(5))
        return _pixels(t, (1 + amount) * t.shifted(0, 0) - amount * mean)

    return over_tiles(pixels, keys, height, width, 2, work, "y int, x int, v double", fill, "zero", tile)


def bilateral(pixels: DataFrame, keys: list[str], height: int, width: int, sigma: float, fill: float = 0.0, tile: int = TILE) -> DataFrame:
    """(keys, y, x, v): each pixel as the mean of those within 2 pixels, weighted by normal curves of their distance and of
    their difference in value, both of deviation 25 sigma; beyond the frame lies its mirror image. Values stay unrounded."""
    s = 25.0 * sigma
    disc = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4]

    def work(t: Tile) -> dict[str, np.ndarray]:
        own, total, weight = t.shifted(0, 0), 0.0, 0.0
        for dy, dx in disc:
            v = t.shifted(dy, dx)
            w = math.exp(-(dy * dy + dx * dx) / (2 * s * s)) * np.exp(-((v - own) ** 2) / (2 * s * s))
            total, weight = total + w * v, weight + w
        return _pixels(t, total / weight)

    return over_tiles(pixels, keys, height, width, 2, work, "y int, x int, v double", fill, "mirror", tile)


# ------------------------------------------------------------ gradients and corners
def sobel(t: Tile, grown: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(along x, along y) by the 3 x 3 weights 1 2 1."""
    s = lambda dy, dx: t.shifted(dy, dx, grown)
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    return gx, gy


def octant(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Eighths of a turn from -pi on, by comparisons, so that directions on a border are settled exactly; pi is in the last, no direction in the fifth."""
    up = np.where(gx > gy, 4, np.where(gx > 0, 5, np.where(gy > -gx, 6, 7)))
    down = np.where(gx < 0, np.where(gy > gx, 0, 1), np.where(-gy > gx, 2, 3))
    return np.where(gy > 0, up, np.where(gy < 0, down, np.where(gx < 0, 7, 4)))


def harris(t: Tile, k: float = 0.04) -> np.ndarray:
    """det - k trace^2 of the products of gradients (an eighth of ``sobel``'s) summed over each pixel and those above and left."""
    gx, gy = (g / 8 for g in sobel(t, 1))
    h, w = t.shape
    sums = []
    for f in (gx * gx, gx * gy, gy * gy):
        if t.y == 0 and h > 1:  # beyond the frame lie the products of its mirror image
            f[0] = f[2]
        if t.x == 0 and w > 1:
            f[:, 0] = f[:, 2]
        sums.append(f[: h, : w] + f[1 : h + 1, : w] + f[: h, 1 : w + 1] + f[1 : h + 1, 1 : w + 1])
    a, b, c = sums
    return a * c - b * b - k * (a + c) ** 2


#: The circle of radius 3 that corners are tested on, in order.
CIRCLE = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]


def corner_scores(t: Tile, grown: int) -> np.ndarray:
    """By how much nine pixels in a row of the circle around a pixel are all brighter, or all darker, than it; 0 within 3 pixels of the frame's edge."""
    own = t.shifted(0, 0, grown)
    ring = np.stack([t.shifted(dy, dx, grown) - own for dy, dx in CIRCLE])
    ring = np.concatenate([ring, ring[:8]])
    best = np.zeros_like(own)
    for sign in (1, -1):
        for k in range(16):
            best = np.maximum(best, (sign * ring[k : k + 9]).min(0))
    y = np.arange(own.shape[0])[:, None] + t.y - grown
    x = np.arange(own.shape[1])[None] + t.x - grown
    return np.where((y >= 3) & (y < t.height - 3) & (x >= 3) & (x < t.width - 3), best, 0)


def corners(t: Tile, threshold: float) -> np.ndarray:
    """Whether each pixel is a corner over ``threshold`` whose score exceeds its eight neighbours' (those of no corner count 0)."""
    s = corner_scores(t, 1)
    s = np.where(s > threshold, s, 0)
    h, w = t.shape
    own = s[1:-1, 1:-1]
    around = np.max([s[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    return (own > 0) & (own > around)


def as_bytes(pixels: DataFrame, keys: list[str], height: int, width: int, fill: float = 0.0) -> DataFrame:
    """``v`` of each frame as whole numbers from 0 to 255, its largest value (``fill`` included where a pixel is untouched) as 255; all 0 if that isn't over 0."""
    on = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    top = on.groupBy(*keys).agg(F.max("v").alias("_top"), F.count_distinct("y", "x").alias("_n"))
    most = F.when(F.col("_n") < height * width, F.greatest(F.col("_top"), F.lit(fill))).otherwise(F.col("_top"))
    return on.join(top.select(*keys, most.alias("_most")), keys).withColumn("v", _scaled(F.col("v"), F.col("_most")))


def _scaled(v: Column, most: Column) -> Column:
    return F.when(most > 0, F.floor(F.greatest(v, F.lit(0)) / most * 255)).otherwise(0).cast("double")


def edge_features(pixels: DataFrame, keys: list[str], height: int, width: int, fill: float = 0.0, edge: float = 10.0, threshold: float = 10.0, tile: int = TILE) -> DataFrame:
    """Per frame or patch of sparse pixels, after ``as_bytes``: ``sobel_edge_density`` (share of pixels with a gradient over ``edge``),
    ``sobel_grad_magnitude_mean``, ``sobel_directional_bias`` (largest less smallest share of the eighths of directions, 0 without
    gradients), ``harris_response_mean``, ``harris_response_max`` and ``fast_keypoint_count``. Tiles send a row of sums each."""
    scaled = as_bytes(pixels, keys, height, width, fill)
    # untouched pixels are scaled like others
    joined = scaled.groupBy(*keys).agg(F.first("_most").alias("_most"))
    base = joined.select(*keys, F.lit(-1).alias("y"), F.lit(-1).alias("x"), _scaled(F.lit(float(fill)), F.col("_most")).alias("v"))
    names = [f"d{k}" for k in range(8)]

    def work(t: Tile) -> dict[str, np.ndarray]:
        gx, gy = sobel(t)
        size = np.hypot(gx, gy)
        turn = np.bincount(octant(gx, gy).ravel(), minlength=8)
        r = harris(t)
        sums = {"n": size.size, "edges": (size > edge).sum(), "any": (size > 0).sum(), "size": size.sum(), "r": r.sum(), "top": r.max(), "fast": corners(t, threshold).sum()}
        return {k: np.array([v]) for k, v in (sums | dict(zip(names, turn))).items()}

    dense = _filled(scaled.select(*keys, "y", "x", "v"), base, keys, height, width) if fill else scaled.select(*keys, "y", "x", "v")
    out = "n long, edges long, any long, size double, r double, top double, fast long, " + ", ".join(f"{k} long" for k in names)
    sums = over_tiles(dense, keys, height, width, 4, work, out, 0.0, "mirror", tile)
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", "edges", "any", "size", "r", "fast", *names]], F.max("top").alias("top"))
    bias = (F.greatest(*names) - F.least(*names)) / F.col("n")
    return total.select(*keys, (F.col("edges") / F.col("n")).alias("sobel_edge_density"), (F.col("size") / F.col("n")).alias("sobel_grad_magnitude_mean"), F.when(F.col("any") > 0, bias).otherwise(0.0).alias("sobel_directional_bias"), (F.col("r") / F.col("n")).alias("harris_response_mean"), F.col("top").alias("harris_response_max"), F.col("fast").alias("fast_keypoint_count"))


def _filled(pixels: DataFrame, base: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """The pixels, and a row for every untouched one with the frame's own fill (``base``)."""
    every = base.select(*keys, F.col("v").alias("_fill"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return every.join(pixels, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("v", "_fill").alias("v"))

