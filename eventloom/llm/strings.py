"""Sorting strings held as columns of 64-bit characters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def multikey_sort(n: int, columns: Iterable[Callable[[np.ndarray], np.ndarray]], at_depth: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with eight bytes as a character: (order, whether a string differs from the one before).

    ``columns``: for each character, a function from numbers of strings to that character. Each is
    asked only for strings that tie with another on all characters before; equal strings keep their
    order. ``at_depth``: filled, for the depths that are its keys, with the second array as of that depth.
    """
    order, first = np.arange(n), np.zeros(n, bool)
    first[:1] = True
    for depth, column in enumerate(columns, 1):
        more = np.append(first[1:], True)
        tied = np.flatnonzero(~(first & more))
        if len(tied):
            run, value = np.cumsum(first)[tied], column(order[tied])
            if run[0] == run[-1]:
                by = np.argsort(value, kind="stable")
            else:
                by = np.argsort(value, kind="stable")
                by = by[np.argsort(run[by], kind="stable")]
            run, value, order[tied] = run[by], value[by], order[tied][by]
            change = np.ones(len(tied), bool)
            change[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
            first[tied] = change
        if at_depth is not None and depth in at_depth:
            at_depth[depth] = first.copy()
    return order, first


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` the eight bytes from there on as one big-endian number, so
    that numbers sort as bytes do; the last seven places have none."""
    view = np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(0, len(data) - 7), 8), (1, 1))
    return view.view(">u8")[:, 0] if len(data) > 7 else np.zeros(0, ">u8")
