"""Vectors of counts that tasks send in blocks and that are summed in a tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, shuffle_partitions

#: Counts of a block of a long vector.
BLOCK = 4096
#: Sums of a block at the tree's lower level.
SALTS = 16
#: Rows of an Arrow batch that is given out.
_ROWS = 256

VECTORS = "block long, part long, size int, at binary, counts binary"


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys of 64 bits, mixed (the finaliser of SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_of(vector: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of a long vector that are not all zero."""
    for a in range(0, len(vector), BLOCK):
        part = vector[a : a + BLOCK]
        if part.any():
            yield a // BLOCK, part


def vector_rows(vectors: Iterable[tuple[int, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    """Rows of `VECTORS`; of a vector that is mostly zeros, only the rest and where it stands."""
    rows: list[tuple[int, int, int, bytes | None, bytes]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, ["block", "part", "size", "at", "counts"])

    for block, v in vectors:
        v = np.ascontiguousarray(v, np.int64)
        at = np.flatnonzero(v)
        if at.size * 3 < v.size:
            rows.append((block, part, v.size, at.astype(np.int32).tobytes(), v[at].tobytes()))
        else:
            rows.append((block, part, v.size, None, v.tobytes()))
        if len(rows) >= _ROWS:
            yield batch()
    if rows:
        yield batch()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector of each key, in a stream that is sorted by it; rows are added up as they come."""
    out: list[tuple[int, np.ndarray]] = []
    for b in batches:
        for key, size, at, counts in zip(b["block"].to_pylist(), b["size"].to_pylist(), b["at"], b["counts"]):
            if not out or out[-1][0] != key:
                if len(out) >= _ROWS:
                    yield from vector_rows(out, 0)
                    out = []
                out.append((key, np.zeros(size, np.int64)))
            v = np.frombuffer(counts.as_buffer(), np.int64)
            if at.is_valid:
                out[-1][1][np.frombuffer(at.as_buffer(), np.int32)] += v
            else:
                out[-1][1][:] += v
    yield from vector_rows(out, 0)


def tree_sum(vectors: DataFrame) -> DataFrame:
    """One row of `VECTORS` for each block: the vectors of all tasks, added up in two levels, so that no task gets all of a block's."""
    parts = shuffle_partitions(vectors.sparkSession)
    salted = vectors.withColumn("block", F.col("block") * SALTS + F.pmod("part", F.lit(SALTS)))
    low = salted.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_summed, VECTORS)
    high = low.withColumn("block", F.floor(F.col("block") / SALTS))
    return high.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_summed, VECTORS)


def expanded(row: dict) -> np.ndarray:
    """The vector of a row of `VECTORS`."""
    v = np.frombuffer(row["counts"], np.int64)
    if row["at"] is None:
        return v
    out = np.zeros(row["size"], np.int64)
    out[np.frombuffer(row["at"], np.int32)] = v
    return out


def vector_entries(vectors: DataFrame, first: int = 0) -> DataFrame:
    """(no, n) for every count over 0 of summed vectors: its place in the whole vector, counted from `first`."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                v = expanded(row)
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(at + row["block"] * BLOCK + first), pa.array(v[at])], ["no", "n"])

    return vectors.mapInArrow(entries, "no long, n long")


def numbered(df: DataFrame, scratch: Scratch, name: str, first: int = 1) -> tuple[DataFrame, int]:
    """`df`, saved, with a column `no` that counts from `first` without gaps, and the number of rows.

    Rows are counted by the task that wrote them, so none has to see them all.
    """
    raw = scratch.save(df.withColumn("_id", F.monotonically_increasing_id()), f"{name}-raw")
    sizes = raw.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = [], first
    for r in sizes:
        starts.append((r["_part"], at))
        at += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = raw.withColumn("_part", F.shiftright("_id", 33)).join(offsets, "_part").withColumn("no", F.col("_start") + low).drop("_id", "_part", "_start")
    saved = scratch.save(rows, name)
    scratch.drop(f"{name}-raw")
    return saved, at - first
