"""Batches of rows in Arrow streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_key(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each value of `name`, in a stream that is sorted by it."""
    held, at = [], None
    for b in batches:
        v = b[name].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            if held and v[a] != at:
                yield at, pa.concat_batches(held)
                held = []
            at = v[a]
            held.append(b.slice(a, z - a))
    if held:
        yield at, pa.concat_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], name: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows or more that hold all rows of each value of `name`, in a sorted stream."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        v = b[name].to_numpy(zero_copy_only=False)
        if not len(v):
            continue
        if size >= rows:
            # the last value held may go on in this batch
            last = held[-1][name][len(held[-1]) - 1].as_py()
            differs = np.flatnonzero(v != last)
            cut = int(differs[0]) if differs.size else len(v)
            if cut:
                held.append(b.slice(0, cut))
            if cut < len(v):
                yield pa.concat_batches(held)
                held, size = [b.slice(cut)], len(v) - cut
            continue
        held.append(b)
        size += len(v)
    if held:
        yield pa.concat_batches(held)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few texts are Python objects at a time."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def keep_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[list], Sequence[bool]]]) -> DataFrame:
    """The rows of `df`, with all their columns, for whose values of `column` the test holds.

    `keep` is called once in each task and returns the test of a batch of values.
    """
    names, at = df.columns, df.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for b in slices(batches):
            yield b.filter(pa.array(test(b.column(at).to_pylist()), pa.bool_()))

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(kept, df.toDF(*[f"c{k}" for k in range(len(names))]).schema).toDF(*names)
