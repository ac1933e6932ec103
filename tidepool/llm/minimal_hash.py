"""Minimal perfect hashes of a table of keys, bucket by bucket.

Keys fall into buckets of some thousands; each bucket is solved by hash and
displace in the task that has it: its keys are dealt to small groups, and the
groups, largest first, get a step and a shift that put their keys on free
slots.  A function needs about a byte a key; keys stand beside their slots, so
that a looked-up key is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import by_key
from tidepool.llm.dense import mixed
from tidepool.llm.shared import shuffle_partitions

#: Keys of a bucket, on average, and of a group.
BUCKET, GROUP = 4096, 4
_STEPS = 64

HASHES = "bucket int, seed long, keys binary, moves binary"


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _places(keys: np.ndarray, seed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first place, step) of keys of buckets that have `size` keys."""
    h = mixed(keys.astype(np.uint64) ^ mixed(seed.astype(np.uint64)))
    n = size.astype(np.uint64)
    groups = (n + np.uint64(GROUP - 1)) // np.uint64(GROUP)
    a, b, c = h & np.uint64(0xFFFFF), (h >> np.uint64(20)) & np.uint64(0x3FFFFF), h >> np.uint64(42)
    return (a % groups).astype(np.int64), (b % n).astype(np.int64), (c % n).astype(np.int64)


def solve(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, keys by slot, move of each group) of different keys; a move is 65 536 times a step, and a shift."""
    n = len(keys)
    for seed in range(1000):
        group, first, step = _places(keys, np.full(n, seed), np.full(n, n))
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=-(-n // GROUP))
        starts = np.cumsum(sizes) - sizes
        free = np.ones(2 * n, bool)  # twice, so that places that go round need no modulo
        moves, slot = np.zeros(sizes.size, np.int32), np.zeros(n, np.int64)
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] < 2:
                break
            own = order[starts[g] : starts[g] + sizes[g]]
            for d in range(_STEPS):
                at = (first[own] + d * step[own]) % n
                if len(set(at.tolist())) < at.size:
                    continue
                fits = free[at[0] : at[0] + n].copy()
                for x in at[1:]:
                    fits &= free[x : x + n]
                shift = int(np.argmax(fits))
                if fits[shift]:
                    slot[own] = (at + shift) % n
                    free[slot[own]] = free[slot[own] + n] = False
                    moves[g] = d << 16 | shift
                    break
            else:
                break
        else:
            g = -1
        if g >= 0 and sizes[g] >= 2:
            continue  # keys that no step tells apart: another seed
        single = np.flatnonzero(sizes == 1)
        own = order[starts[single]]
        slot[own] = np.flatnonzero(free[:n])
        moves[single] = (slot[own] - first[own]) % n
        out = np.zeros(n, np.int64)
        out[slot] = keys
        return seed, out, moves
    raise ValueError("keys of a bucket can't be told apart: are they different?")


def hash_buckets(keys: DataFrame, many: int) -> tuple[DataFrame, int]:
    """(rows of `HASHES`, number of buckets) of a table of `many` different keys (key)."""
    buckets = max(1, -(-many // BUCKET))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b["key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(k, buckets).astype(np.int32)), b["key"]], ["bucket", "key"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in by_key(batches, "bucket"):
            seed, slots, moves = solve(np.sort(b["key"].to_numpy()))
            yield pa.RecordBatch.from_pylist([{"bucket": int(at), "seed": seed, "keys": slots.tobytes(), "moves": moves.tobytes()}], _SCHEMA)

    dealt = keys.select(F.col("key").cast("long")).mapInArrow(bucket, "bucket int, key long")
    dealt = dealt.repartition(shuffle_partitions(keys.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(solved, HASHES), buckets


_SCHEMA = pa.schema([("bucket", pa.int32()), ("seed", pa.int64()), ("keys", pa.binary()), ("moves", pa.binary())])


@dataclass
class MinimalHash:
    """The function of some of the buckets, numbered from `low`."""

    buckets: int
    low: int
    seeds: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    moves: np.ndarray
    groups: np.ndarray
    keys: np.ndarray

    @classmethod
    def from_rows(cls, rows: list, buckets: int, low: int, high: int) -> MinimalHash:
        """Of collected rows of `HASHES` of the buckets from `low` to below `high`, ordered by bucket; those without keys have no row."""
        seeds, sizes = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
        for r in rows:
            seeds[r["bucket"] - low], sizes[r["bucket"] - low] = r["seed"], len(r["keys"]) // 8
        many = -(-sizes // GROUP)
        keys = np.frombuffer(b"".join(r["keys"] for r in rows), np.int64)
        moves = np.frombuffer(b"".join(r["moves"] for r in rows), np.int32)
        return cls(buckets, low, seeds, sizes, np.cumsum(sizes) - sizes, moves, np.cumsum(many) - many, keys)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys belong to these buckets, their slots); a key that is not in the table is an error."""
        bucket = buckets_of(keys, self.buckets) - self.low
        mine = np.flatnonzero((bucket >= 0) & (bucket < len(self.sizes)))
        bucket = bucket[mine]
        if (self.sizes[bucket] == 0).any():
            raise KeyError("a key that was not hashed")
        group, first, step = _places(keys[mine], self.seeds[bucket], self.sizes[bucket])
        move = self.moves[self.groups[bucket] + group].astype(np.int64)
        slot = self.starts[bucket] + (first + (move >> 16) * step + (move & 0xFFFF)) % self.sizes[bucket]
        if (self.keys[slot] != keys[mine]).any():
            raise KeyError("a key that was not hashed")
        return mine, slot
