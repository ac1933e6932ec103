"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles (see `shingles`).  The
shingle hashes are XOR-ed into a bit sketch: each toggles one bit, so bits of
shared shingles cancel when two sketches are XOR-ed and the Hamming distance
never exceeds the symmetric difference.  Sets with
100 * |A & B| >= 75 * |A | B| have a symmetric difference of at most
(|A| + |B|) / 7.

Candidates come from the pigeonhole principle.  Within a size band the sketch
is a row of blocks, each so wide that its bits are kept as the XOR of their
64-bit codes.  If two sets differ in at most D elements, at most D blocks
differ.  Empty blocks are no keys: in the order of blocks, the k-th block that
agrees is among the first D + k non-empty blocks of either set, so a set needs
to give away no more keys than that, and a set with fewer than k keys that
another set has too can have no partner.  Among the m keys it shares, any
partner agrees on at least k, so one of the m - k + 1 rarest is common to
both: keys of passages that many documents share are hardly ever used.  Sets
whose blocks are too crowded for this also give keys of one shingle each.

Work is by distinct set (copies are one vertex).  Links are found in steps:
cheap ones to a pivot of each key group, and to the likeliest partners among
the members of a few keys, which unite most members of large groups of near
copies, then, for every key whose members are not yet in one component, all
pairs across components that pass the Hamming bound.  All are verified on the
whole sets.  Only pairs within one component are ever
left out, so components are exact; groups over BLOCK members are compared in
blocks by several tasks.

A set goes by the first half of a 128-bit fingerprint.  Where two different
sets share that half, as their second halves tell, both go by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import by_key, slices, whole_groups
from tidepool.llm.components import connected_components, joined_components
from tidepool.llm.shared import Scratch, fresh_names, near, shuffle_partitions
from tidepool.llm.shingles import mix, shingles

#: Two sets link when LEAST * |A | B| <= 100 * |A & B|.
LEAST = 75
#: Keys of a set that start a cheap link to a pivot.
PIVOT_KEYS = 3
#: Rounds that look for more cheap links among the members of those keys, and how many each member tries.
THIN_ROUNDS, BEST = 2, 3
#: Salts of a pivot's group.
SALTS = 64
#: Groups of more than 2 * BLOCK members of a key are compared in blocks: up to 5 of about BLOCK members, or more of 5 * BLOCK.
BLOCK = 400
FLUSH_KEYS = 500_000
#: Bytes of a key that travel beside the number of its bucket.  Equal short keys of different blocks only add candidates.
KEY_BYTES = 5

_U = np.uint64
_RUN = np.dtype([("node", "<u8"), ("count", "<u4"), ("need", "<i4"), ("view", "<i2")])
_FINE = 100


def _band(n: int) -> int:
    return n.bit_length() - 1


def _farthest(n: int, below: int) -> int:
    """The largest symmetric difference to a partner of fewer than `below` elements."""
    return (n + min(n * 100 // LEAST, below - 1)) * (100 - LEAST) // (100 + LEAST)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, in halves."""
    g = mix(s + _U(0x5851F42D4C957F2D))
    a, b = _U(s.size), _U(s.size)
    if s.size:
        a, b = np.add.reduce(g), np.bitwise_xor.reduce(mix(g))
    with np.errstate(over="ignore"):
        both = mix(np.array([a + _U(s.size), b ^ a], dtype=_U))
    return int(both[0]), int(both[1])


def block_keys(s: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each view of a set: its number, its keys and how many of them a partner must share."""
    n = s.size
    codes = mix(s ^ _U(0xD6E8FEB86659FD93))
    own = _band(n)
    last = _band(n * 100 // LEAST)
    for band in range(own, last + 1):
        far = _farthest(n, 2 << band)
        block = s >> _U(64 - band) if band else np.zeros(n, _U)
        at = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
        parity = np.bitwise_xor.reduceat(codes, at)
        kinds = [(band, parity, block[at])]
        if at.size <= far:
            kinds.append((_FINE + band, codes, np.zeros(n, _U)))
        for view, value, where in kinds:
            take = min(value.size, far + 1 + n // 10)
            need = min(1 + (LEAST * n // 100) // 10, value.size - far)
            salt = mix(np.array([view + 1], _U))
            keys = mix(value[:take] + where[:take] * _U(0x9E3779B97F4A7C15) + salt)
            yield view, keys, max(need, 1)


def parity_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of a sketch of `bits` bits, a power of two of at least 8."""
    at = mix(s + _U(0x2545F4914F6CDD1D)) & _U(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def _sketch_bytes(band: int) -> int:
    return max(1, (4 << band) // 8)


class Names:
    """What sets go by: the first half of the fingerprint, or the second where the first is that of several sets.

    `bits` of the first half are used; fewer than 64 are for tests.
    """

    def __init__(self, bits: int, taken: list[int] | None = None) -> None:
        self.mask = (1 << bits) - 1
        self.taken = frozenset(taken or ())

    def halves(self, s: np.ndarray) -> tuple[int, int]:
        first, second = fingerprint(s)
        return first & self.mask, second

    def of(self, s: np.ndarray) -> int:
        first, second = self.halves(s)
        return second if first in self.taken else first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=_U).view(np.int64))


def _profiles(names: Names):
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, first, second = [], [], []
            for s in shingles(b["text"].to_pylist()):
                n.append(s.size)
                f = names.halves(s)
                first.append(f[0])
                second.append(f[1])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["version"], pa.array(n, pa.int64()), _signed(np.array(first, _U)), _signed(np.array(second, _U))],
                ["doc_id", "version", "n_shingles", "node", "node2"],
            )

    return profiles


def _packed(keys: np.ndarray) -> bytes:
    """The lowest KEY_BYTES bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _whole_keys(b: pa.RecordBatch, bucket: int, buckets: int) -> np.ndarray:
    """The packed keys of a bucket, with its number put back, so that keys of different buckets differ."""
    short = np.frombuffer(b"".join(b["keys"].to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :KEY_BYTES] = short
    return wide.view("<u8").ravel() * _U(buckets) + _U(bucket)


def _key_blobs(buckets: int, names: Names):
    def flush(heads: list, keys: list) -> pa.RecordBatch:
        k = np.concatenate(keys)
        run = np.repeat(np.arange(len(heads)), [h[1] for h in heads])
        bucket = (k % _U(buckets)).astype(np.int64)
        order = np.lexsort((run, bucket))
        k, run, bucket = k[order] // _U(buckets), run[order], bucket[order]
        head = np.array(heads, dtype=_RUN)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        filled, runs, values = [], [], []
        for i in range(buckets):
            a, z = cut[i], cut[i + 1]
            if a < z:
                r, c = np.unique(run[a:z], return_counts=True)
                h = head[r]
                h["count"] = c
                filled.append(i)
                runs.append(h.tobytes())
                values.append(_packed(k[a:z]))
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(runs, pa.binary()), pa.array(values, pa.binary())], ["bucket", "runs", "keys"])

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, keys, size = [], [], 0
        for b in slices(batches):
            for s in shingles(b["text"].to_pylist()):
                if not s.size:
                    continue
                node = names.of(s)
                for view, k, need in block_keys(s):
                    heads.append((node, k.size, need, view))
                    keys.append(k)
                    size += k.size
                if size >= FLUSH_KEYS:
                    yield flush(heads, keys)
                    heads, keys, size = [], [], 0
        if heads:
            yield flush(heads, keys)

    return blobs


def _shared_keys(targets: int, buckets: int):
    """From all keys of a bucket, those of two sets or more, in packed rows by a hash of the set that they go back to."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, b in by_key(batches, "bucket"):
            head, keys = _unpacked(b, "runs", _RUN), _whole_keys(b, int(bucket), buckets)
            run = np.repeat(np.arange(head.size), head["count"])
            # copies of one set give the same keys: the first is enough
            _, first = np.unique(_name(head), return_index=True)
            keep = np.zeros(head.size, bool)
            keep[first] = True
            run, keys = run[keep[run]], keys[keep[run]]
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            new = np.concatenate(([True], k[1:] != k[:-1])) if k.size else np.zeros(0, bool)
            count = np.diff(np.concatenate((np.flatnonzero(new), [k.size])))
            many = np.empty(k.size, np.int32)
            many[order] = np.repeat(count, count)
            hit = many >= 2
            run, keys, many = run[hit], keys[hit], many[hit]
            target = (mix(head["node"][run]) % _U(targets)).astype(np.int64)
            order = np.lexsort((run, target))
            run, keys, many, target = run[order], keys[order], many[order], target[order]
            cut = np.searchsorted(target, np.arange(targets + 1))
            rows = []
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                own = slice(cut[i], cut[i + 1])
                r, c = np.unique(run[own], return_counts=True)
                h = head[r]
                h["count"] = c
                rows.append((i, h.tobytes(), keys[own].tobytes(), many[own].tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["target", "runs", "keys", "counts"])

    return shared


def _name(head: np.ndarray) -> np.ndarray:
    """One number for a set in a view."""
    return mix(head["node"] + mix(head["view"].astype(_U) + _U(1)))


def _unpacked(b: pa.RecordBatch, name: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(b[name].to_pylist()), dtype=kind)


def _ranks(group: np.ndarray) -> np.ndarray:
    """The position of each element within its run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.arange(group.size) - np.repeat(start, np.diff(np.concatenate((start, [group.size]))))


def _lists(group: np.ndarray, values: np.ndarray, groups: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(values))


def _rarest_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set and view that shares enough keys: the rarest of them that it has to give, and a few to start from."""
    for _, b in by_key(batches, "target"):
        head, keys, counts = _unpacked(b, "runs", _RUN), _unpacked(b, "keys", _U), _unpacked(b, "counts", np.dtype("<i4"))
        _, first, group = np.unique(_name(head), return_index=True, return_inverse=True)
        group = np.repeat(group, head["count"])
        shared, need = np.bincount(group, minlength=first.size), head["need"][first].astype(np.int64)
        enough = shared >= need
        keep = enough[group]
        group, keys, counts = (np.cumsum(enough) - 1)[group[keep]], keys[keep], counts[keep]
        give, head = (shared - need + 1)[enough], head[first[enough]]
        by_count, by_hash = np.lexsort((keys, counts, group)), np.lexsort((keys, group))
        rare = by_count[_ranks(group[by_count]) < give[group[by_count]]] if group.size else by_count
        start = by_hash[_ranks(group[by_hash]) < PIVOT_KEYS] if group.size else by_hash
        yield pa.RecordBatch.from_arrays(
            [_signed(head["node"]), pa.array(head["view"].astype(np.int32)), _lists(group[rare], keys[rare], head.size), _lists(group[start], keys[start], head.size)],
            ["node", "view", "rarest", "pivots"],
        )


def _sets(names: Names):
    """The whole set and its sketch for each row (node, text) whose text is of that set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep, n, values, sketches = [], [], [], []
            nodes = b["node"].to_numpy().view(_U)
            for i, s in enumerate(shingles(b["text"].to_pylist())):
                if s.size and names.of(s) == int(nodes[i]):
                    keep.append(nodes[i])
                    n.append(s.size)
                    values.append(s.tobytes())
                    sketches.append(parity_sketch(s, 8 * _sketch_bytes(_band(s.size) + 1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [_signed(np.array(keep, _U)), pa.array(n, pa.int32()), pa.array(values, pa.binary()), pa.array(sketches, pa.binary())],
                ["node", "n", "elements", "sketch"],
            )

    return sets


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, dst = b["src"].to_numpy(), b["dst"].to_numpy()
        keep = np.zeros(len(src), bool)
        for i, (x, y) in enumerate(zip(b["a"], b["b"])):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = np.concatenate((x, y))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * common >= LEAST * (both.size - common)
        yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep])], ["src", "dst"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The saved pairs (src, dst) whose whole sets reach the similarity.

    Pairs are few beside the sets, so they go to the sets; the sets of `src`,
    often pivots of many pairs, are then moved once each.
    """
    with_b = sets.select(F.col("node").alias("dst"), F.col("elements").alias("b")).join(near(pairs), "dst")
    a = sets.select(F.col("node").alias("src"), F.col("elements").alias("a")).join(near(pairs.select("src").distinct()), "src", "left_semi")
    return with_b.join(a, "src").mapInArrow(_verified, "src long, dst long")


def _folded(column: pa.Array, size: int) -> np.ndarray:
    """Sketches of `size` bytes each, as rows of words."""
    lengths = pc.binary_length(column).to_numpy()
    out = np.empty((len(column), size), np.uint8)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(at.size, n // size, size)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out.view(np.uint64) if size % 8 == 0 else out


def _across(best: int):
    """Pairs of a key's members from different components that pass the size and Hamming bounds.

    With `best` over 0, only that many of each member, those with the most room
    under the bound, and none between blocks.
    """

    def pairs_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        group, node, root = (b[c].to_numpy() for c in ("group", "node", "root"))
        n, part = b["n"].to_numpy().astype(np.int64), b["part"].to_numpy()
        two = b["low"].to_numpy() != b["high"].to_numpy()
        words = _folded(b["sketch"], _sketch_bytes(b["view"][0].as_py() % _FINE))
        left, room, found = np.arange(len(node) - 1), [], []
        step = 1
        while left.size:
            left = left[left < len(node) - step]
            left = left[group[left] == group[left + step]]
            i = left[root[left] != root[left + step]]
            j = i + step
            ok = (100 * np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j])) & (~two[i] | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            far = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
            slack = (n[i] + n[j]) * (100 - LEAST) - far * (100 + LEAST)
            ok = slack >= 0
            found.append(np.stack((i[ok], j[ok])))
            room.append(slack[ok] / (n[i] + n[j])[ok])
            step += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        (i, j), r = np.concatenate(found, axis=1), np.concatenate(room)
        if best and i.size:
            x, y, r = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((r, r))
            order = np.lexsort((-r, x))
            x, y = x[order], y[order]
            start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            rank = np.arange(x.size) - np.repeat(start, np.diff(np.concatenate((start, [x.size]))))
            i, j = x[rank < best], y[rank < best]
        return node[i], node[j]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "group", 4_000):
            for view in np.unique(chunk["view"].to_numpy()).tolist():
                own = chunk.filter(pa.array(chunk["view"].to_numpy() == view))
                a, z = pairs_of(own)
                both = np.unique(np.stack((np.minimum(a, z), np.maximum(a, z))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["src", "dst"])

    return across


def _candidates(members: DataFrame, roots: DataFrame, sets: DataFrame, best: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs to verify (src, dst) among the members (key, view, node) of keys that join several components."""
    parts = shuffle_partitions(members.sparkSession)
    members = members.join(near(roots), "node", "left").select("key", "view", "node", F.coalesce("root", "node").alias("root"))
    members = scratch.save(members, f"{name}-members")
    # of keys with the same members one is enough: long texts can share as many keys as they have words
    same = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1)]
    mixed = members.groupBy("key", "view").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same).where("lo < hi")
    mixed = mixed.groupBy("view", "m", "x0", "x1").agg(F.min("key").alias("key"))
    mixed = scratch.save(mixed.select("key", "view", F.when(F.col("m") > 2 * BLOCK, F.ceil(F.col("m") / F.least(F.greatest(F.col("m") / 5, F.lit(BLOCK)), F.lit(5 * BLOCK)))).otherwise(1).cast("int").alias("parts")), f"{name}-mixed")
    own = members.join(near(mixed), ["key", "view"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1) if not best else F.array("part")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    dealt = (
        own.withColumn("other", F.explode(others))
        .select("view", "node", "root", "part", low.alias("low"), high.alias("high"), F.xxhash64("key", "view", low, high).alias("group"))
        .join(sets.select("node", "n", "sketch"), "node")
    )
    pairs = dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_across(best), "src long, dst long").distinct()
    return scratch.save(pairs, f"{name}-pairs")


def _versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): `version` tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def _classes(rows: DataFrame, names: Names, scratch: Scratch) -> tuple[DataFrame, DataFrame, Names]:
    """A profile of each row, the classes (node, first, twice) of rows with one set, and the names in use.

    `first` is the smallest (doc_id, version) of a class, with the number of
    rows that repeat it.
    """

    def classed(profile: DataFrame) -> DataFrame:
        known = profile.where("n_shingles > 0 and doc_id is not null")
        rows = known.groupBy("node", "node2", "doc_id", "version").agg(F.count("*").alias("rows"))
        return rows.groupBy("node").agg(F.min(F.struct("doc_id", "version", "rows")).alias("first"), (F.min("node2") != F.max("node2")).alias("twice"))

    profile = rows.mapInArrow(_profiles(names), "doc_id long, version long, n_shingles long, node long, node2 long")
    profile = scratch.save(profile.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node"))), "profile")
    classes = scratch.save(classed(profile), "classes")
    # of n sets about n * n / 2 ** 65 share a first half: none at all up to billions
    taken = [r["node"] for r in classes.where("twice").select("node").collect()]
    if taken:
        table = rows.sparkSession.createDataFrame([(x,) for x in taken], "node long").withColumn("_taken", F.lit(True))
        renamed = profile.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("_taken"), F.col("node2")).otherwise(F.col("node"))).drop("_taken")
        profile = scratch.save(renamed.select(profile.columns), "renamed")
        classes = scratch.save(classed(profile), "reclassed")
        if classes.where("twice").count():
            raise ValueError("different sets share a half of their fingerprints twice over")
        names.taken = frozenset(x & ((1 << 64) - 1) for x in taken)
    return profile, classes, names


def _linked_classes(docs: DataFrame, scratch: Scratch, fingerprint_bits: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row (doc_id, version, n_shingles, node), and for each set (node) the first (doc_id, version) of its component."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = _versions(docs)
    profile, classes, names = _classes(docs, Names(fingerprint_bits), scratch)

    shared = (
        docs.where("doc_id is not null and text is not null")
        .mapInArrow(_key_blobs(2 * parts, names), "bucket int, runs binary, keys binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_shared_keys(2 * parts, 2 * parts), "target int, runs binary, keys binary, counts binary")
        .repartition(parts, "target").sortWithinPartitions("target")
        .mapInArrow(_rarest_keys, "node long, view int, rarest array<long>, pivots array<long>")
    )
    shared = scratch.save(shared, "shared")
    wanted = shared.select("node").distinct().join(classes, "node").select("node", "first.doc_id", "first.version", "first.rows")
    wanted = scratch.save(wanted, "wanted")
    texts = docs.join(near(wanted.where("rows = 1")), ["doc_id", "version"]).select("node", "text")
    repeated = wanted.where("rows > 1")
    if not repeated.isEmpty():
        # one of the rows that repeat a doc_id and a text
        one = docs.join(repeated, ["doc_id", "version"]).groupBy("node").agg(F.min("text").alias("text"))
        texts = texts.unionByName(one)
    sets = scratch.save(texts.mapInArrow(_sets(names), "node long, n int, elements binary, sketch binary"), "sets")

    pivots = (
        shared.select("node", F.explode(F.array_distinct("pivots")).alias("key")).groupBy("key", F.pmod(F.hash("node"), F.lit(SALTS)).alias("salt"))
        .agg(F.collect_set("node").alias("nodes"), F.min("node").alias("pivot"))
    )
    pivots = scratch.save(pivots, "pivots")
    stars = pivots.select(F.col("pivot").alias("src"), F.explode("nodes").alias("dst")).unionByName(
        pivots.groupBy("key").agg(F.min("pivot").alias("src"), F.collect_set("pivot").alias("all")).select("src", F.explode("all").alias("dst"))
    )
    stars = scratch.save(stars.where("src <> dst").distinct(), "stars")
    links = scratch.save(_verify(stars, sets), "links")
    cheap = shared.select("node", "view", F.explode(F.array_distinct("pivots")).alias("key"))
    roots = scratch.save(connected_components(links, scratch, "stars"), "roots")
    for k in range(THIN_ROUNDS):
        more = _verify(_candidates(cheap, roots, sets, BEST, scratch, f"thin{k}"), sets)
        links = scratch.save(links.unionByName(more), f"links{k}")
        roots = joined_components(roots, links, scratch, f"joined{k}")
    rarest = shared.select("node", "view", F.explode(F.array_distinct("rarest")).alias("key"))
    more = scratch.save(_verify(_candidates(rarest, roots, sets, 0, scratch, "all"), sets), "more")
    scratch.drop("sets", "all-members", "all-mixed", "all-pairs", "pivots", "shared", "wanted")

    roots = joined_components(roots, more, scratch, "last")
    own = classes.select("node", F.struct("first.doc_id", "first.version").alias("own"))
    leaders = roots.join(own, "node").groupBy("root").agg(F.min("own").alias("leader"))
    leader = roots.join(leaders, "root").select("node", "leader")
    leader = scratch.save(own.join(leader, "node", "left").select("node", F.coalesce("leader", "own").alias("leader")), "leader")
    return profile, leader


def jaccard_components(docs: DataFrame, scratch: Scratch | None = None, fingerprint_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Null texts and texts without words have an empty set and link with
    nothing.  Rows with one doc_id and different texts are vertices of their
    own; a null doc_id gives a null component and is linked with nothing.
    Repeated rows stay and share their component.  An empty table gives no
    rows.  Other columns are ignored.
    """
    profile, leader = _linked_classes(docs, scratch or Scratch(docs.sparkSession, "jaccard"), fingerprint_bits)
    return profile.join(leader, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("leader.doc_id", "doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (with columns doc_id, text), one of each component: that with the smallest doc_id.

    Where that doc_id has several texts of the component, one of them stays.
    Rows without a doc_id all stay, as do texts without words, which link with
    nothing; of rows that repeat a doc_id and text one stays.  An empty table
    gives no rows; other columns may have any names.
    """
    profile, leader = _linked_classes(docs, Scratch(docs.sparkSession, "jaccard"), 64)
    both = profile.where("doc_id is not null").join(leader, "node", "left").where("leader is null or (leader.doc_id = doc_id and leader.version = version)")
    one, version, rows = fresh_names(docs, "kept_doc", "kept_version", "kept_rows")
    kept = both.groupBy(F.col("doc_id").alias(one), F.col("version").alias(version)).agg(F.count("*").alias(rows))
    held = docs.join(kept, (F.col("doc_id").cast("long") == F.col(one)) & (F.xxhash64("text") == F.col(version)))
    held = held.where(F.col(rows) == 1).unionByName(held.where(F.col(rows) > 1).dropDuplicates(["doc_id", "text"]))
    return held.drop(one, version, rows).union(docs.where("doc_id is null"))
