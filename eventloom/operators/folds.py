"""Folds whose next step depends on the last one kept.

Rows of a sequence are brought together and sorted by Spark (which spills),
and the fold reads them as a stream of Arrow batches, with one row of state. A sequence
may be longer than memory; different sequences run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, by: str, order: list[str], step: Callable[[dict | None, dict], tuple[dict | None, list[dict]]], schema: str, finish: Callable[[dict | None], list[dict]] | None = None) -> DataFrame:
    """Run ``step(state, row) -> (state, rows out)`` over each sequence in order.

    The state of a new sequence is None; ``finish`` may give rows at its end.
    """
    kind = df.sparkSession.createDataFrame([], schema)
    fields = [(f.name, f.dataType.simpleString()) for f in kind.schema.fields]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, state, out = False, None, None, []
        for b in batches:
            for row in b.to_pylist():
                if not started or row[by] != key:
                    if finish and started:
                        out += finish(state)
                    started, key, state = True, row[by], None
                state, rows = step(state, row)
                out += rows
            if len(out) >= 5000:
                yield table(out)
                out = []
        if finish and started:
            out += finish(state)
        yield table(out)

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow[k]) for n, k in fields], [n for n, _ in fields])

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


#: Children of a node of the tree of ``running_sum``.
FAN = 16


def _adder() -> Callable[[float], float]:
    """Takes the values of a sequence one by one and gives their sums so far: those of whole nodes, the largest first, then the rows left over.
    Sixteen rows or nodes make a node. ``nodes`` are the sums of the unfinished nodes of each level, ``sums`` those so far at its last child."""
    nodes, sums, n = [0.0], [0.0], 0

    def add(v: float) -> float:
        nonlocal n
        n, level = n + 1, 0
        m = n
        while True:
            nodes[level] += v
            sums[level] += v
            if m % FAN:
                break
            m, v, nodes[level] = m // FAN, nodes[level], 0.0
            level += 1
            if level == len(nodes):
                nodes.append(0.0)
                sums.append(0.0)
        for k in range(level):
            sums[k] = sums[level]
        return sums[0]

    return add


def running_sum(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (double, never null) up to and including each row of a sequence. It is added up in a tree, as the
    window sums of the SQL beside the queries are, so that the last bits agree too and errors grow with the levels; a sum for each level is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, add = False, None, _adder()
        for b in batches:
            out = []
            for own, v in zip(b.column(by).to_pylist(), b.column(value).to_pylist()):
                if not started or own != key:
                    started, key, add = True, own, _adder()
                out.append(add(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    kinds = [*(f"`{n}` {k}" for n, k in df.dtypes), f"`{name}` double"]
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, ", ".join(kinds))
