"""Learned models over frames: batches of frames through a model that each worker loads once.

A model is made by a function without arguments (which may read weights, or open a session of some runtime) and is called with
arrays. ``describe`` is for models without memory: any frame can go to any task. ``reconstruct`` is for recurrent ones: the frames of a
sequence pass in order, and nothing else is carried from frame to frame than what the model returns as its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict = {}


def loaded(make: Callable, name: str):
    """The model, made at the first call in a worker; only one is kept."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = make()
    return _LOADED[name]


def _frames(batch: pa.RecordBatch, pixels: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, frames as arrays) of a batch, those of one size together."""
    sizes = np.stack([batch.column(c).to_numpy() for c in ("height", "width")], 1)
    raw = batch.column(pixels)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(1))
        yield at, np.stack([np.frombuffer(raw[int(k)].as_py(), np.uint8).reshape(size) for k in at])


def describe(frames: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str, pixels: str = "pixels", together: int = 64) -> DataFrame:
    """``frames`` (height, width, pixels of 8-bit gray, more) with ``vec`` in place of the pixels: the model's rows for (frames, height, width) arrays,
    given ``together`` frames of one size at most at a time. Frames with null pixels have a null ``vec``."""
    kept = [c for c in frames.columns if c != pixels]
    schema = ", ".join(f"`{n}` {k}" for n, k in frames.dtypes if n != pixels) + ", vec array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(make, name)
        for batch in batches:
            out: list = [None] * batch.num_rows
            there = np.flatnonzero(batch.column(pixels).is_valid().to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(there))
            for at, x in _frames(some, pixels) if len(there) else ():
                for k in range(0, len(at), together):
                    for row, vec in zip(at[k : k + together], model(x[k : k + together])):
                        out[there[row]] = vec.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(pa.float64()))], [*kept, "vec"])

    return frames.mapInArrow(run, schema)


def reconstruct(frames: DataFrame, by: str, order: list[str], make: Callable[[], Callable], name: str, pixels: str = "pixels") -> DataFrame:
    """``frames`` with ``out``, bytes of an image of the same size: ``model(frame, state) -> (image, state)`` over each sequence ``by`` in ``order``, from
    the state None. Rows are sorted by Spark and read as a stream, so a sequence may be longer than memory; sequences run
    in parallel. A frame with null pixels gives null and leaves the state."""
    kept = frames.columns
    schema = ", ".join(f"`{n}` {k}" for n, k in frames.dtypes) + ", out binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state, now, begun = loaded(make, name), None, None, False
        for batch in batches:
            out = []
            for key, h, w, raw in zip(*(batch.column(c).to_pylist() for c in (by, "height", "width", pixels))):
                if not begun or key != now:
                    state, now, begun = None, key, True
                image = None
                if raw is not None:
                    image, state = model(np.frombuffer(raw, np.uint8).reshape(h, w), state)
                    image = np.asarray(image, np.uint8).tobytes()
                out.append(image)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*kept, "out"])

    return frames.repartition(F.col(by)).sortWithinPartitions(by, *order).mapInArrow(run, schema)


# ------------------------------------------------------------ small networks of fixed weights
def _convolved(x: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """(n, h, w) by (c, 3, 3) to (n, c, h, w), zeros beyond the edge."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    h, w = x.shape[1:]
    return sum(kernels[None, :, a, b, None, None] * p[:, None, a : a + h, b : b + w] for a in range(3) for b in range(3))


def tiny_describer() -> Callable[[np.ndarray], np.ndarray]:
    """Four 3 x 3 kernels (mean, both gradients, Laplace), the positive part of each, averaged over the quarters of the frame, scaled to length 1."""
    kernels = np.array([[[1, 1, 1], [1, 1, 1], [1, 1, 1]], [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]], [[0, 1, 0], [1, -4, 1], [0, 1, 0]]], float)

    def model(x: np.ndarray) -> np.ndarray:
        y = np.maximum(_convolved(x / 255.0, kernels), 0)
        h, w = x.shape[1] // 2, x.shape[2] // 2
        parts = [y[:, :, a, b].mean((2, 3)) for a in (slice(0, h), slice(h, None)) for b in (slice(0, w), slice(w, None))]
        vec = np.concatenate(parts, 1)
        return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-8)

    return model


def tiny_reconstructor() -> Callable:
    """A recurrent unit per pixel: the state moves by a quarter toward the frame's 3 x 3 mean; its image is the state, rounded down (a millionth below a whole number counts as that)."""

    def model(x: np.ndarray, state):
        mean = _convolved(x[None].astype(float), np.full((1, 3, 3), 1 / 9))[0, 0]
        state = mean if state is None or state.shape != mean.shape else 0.75 * state + 0.25 * mean
        return np.floor(np.clip(state, 0, 255) + 1e-6), state

    return model
