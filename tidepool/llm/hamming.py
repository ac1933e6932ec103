"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation that makes the signs of centred, rotated vectors balanced binary
codes is learned on a bounded sample (`fit_rows`).  The sample's groups of near
copies count about once in the centre and the rotation: else a group that holds
a third of all rows would pull the centre into itself, and its codes would be
noise.  Where the centre lies in such a group all the same (if there is hardly
anything else), the origin takes its place.  Codes longer than the vectors come
from further rotations.

Every code is cut into substrings, each the key of one hash table.  A substring's
bits follow the number of vectors, so that a table's buckets stay small.  Pairs
made at the least cosine from sample vectors tell how many tables are needed to
miss fewer than `miss` of them, and how far apart the whole codes of such pairs
lie.  Only codes go to the tables; a vector whose code is near no other in any
bucket goes no further.  The rest meet again with their original vectors, and
are reranked by cosine in double precision.

Equal vectors are one vertex with a count.  No pair is ever written: within a
bucket, cosines are a matrix product, a pair counts in the first table where
it meets, and only counts by vector and the trees of linked vectors go out.
Buckets over BLOCK vectors are compared in blocks by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.arrow import by_key
from tidepool.llm.components import connected_components
from tidepool.llm.shared import Scratch, shuffle_partitions

BLOCK = 1000
#: Bits by which near copies in the sample are found, and pairs made to plan the tables.
COARSE_BITS, TRIALS = 16, 4000
#: Tables beyond which a plan is refused.
MOST_TABLES = 256


def one_of_each_copy(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """The rows of a sample, about one of each group of near copies."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], COARSE_BITS))
    code = (x @ planes >= 0) @ (1 << np.arange(COARSE_BITS))
    return x[np.unique(code, return_index=True)[1]]


def learn_rotation(x: np.ndarray, rounds: int = 50, seed: int = 7) -> np.ndarray:
    """The rotation of principal axes that brings centred rows closest to the corners of a cube."""
    axes = np.linalg.svd(x.T @ x)[0]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return axes @ r


def substring_bits(rows: int) -> int:
    """Bits of a substring for so many vectors."""
    return min(24, max(8, round(math.log2(max(rows, 1) / 256 + 1))))


@dataclass
class Coder:
    """Codes of `tables` substrings of `bits` bits; codes of linked vectors differ in at most `far` bits."""

    centre: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int = 0
    far: int = 0

    def signs(self, x: np.ndarray) -> np.ndarray:
        c = x - self.centre
        return np.concatenate([c @ r >= 0 for r in self.rotations], axis=1)[:, : self.bits * self.tables]

    def parts(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def pairs_at(x: np.ndarray, cosine: float, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """TRIALS unit rows of a sample, and for each another at a cosine to it."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), TRIALS)]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)


def plan_codes(sample: np.ndarray, rows: int, least: float, miss: float) -> Coder:
    """The coder for so many vectors; by the misses of trial pairs, and by those that independent bits would give."""
    width, bits = sample.shape[1], substring_bits(rows)
    x = one_of_each_copy(sample)
    a, b = pairs_at(sample, least)
    found = []
    for centre in (x.mean(axis=0), np.zeros(width)):
        coder = Coder(centre, [learn_rotation(x - centre, seed=0)], 1, width)
        flips = (coder.signs(a) != coder.signs(b)).mean(axis=1)
        found.append((((1 - (1 - flips) ** bits) ** 8).mean(), coder))
    # the centre, unless pairs keep much less of their codes about it than about the origin
    coder = found[0][1] if found[0][0] <= max(0.05, 4 * found[1][0]) else found[1][1]
    coder.bits, coder.tables = bits, 7
    while True:
        coder.tables += 1
        while len(coder.rotations) * width < coder.bits * coder.tables:
            coder.rotations.append(learn_rotation(x - coder.centre, seed=len(coder.rotations)))
        one, two = coder.signs(a), coder.signs(b)
        met = (coder.parts(one) == coder.parts(two)).any(axis=1)
        differ = (one != two).sum(axis=1)
        apart = (1 - (1 - differ.mean() / one.shape[1]) ** coder.bits) ** coder.tables
        if 1 - met.mean() <= miss / 2 and apart <= miss:
            break
        if coder.tables >= MOST_TABLES:
            raise ValueError(f"{MOST_TABLES} tables still miss more than {miss} of the pairs at a cosine of {least}; allow more misses, or compare the vectors otherwise")
    coder.far = min(one.shape[1], max(int(differ.max()), math.ceil(differ.mean() + 6 * differ.std())))
    return coder


def unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of equally long lists, in double precision."""
    x = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    x = x[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(coder: Coder):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            signs = coder.signs(unit_rows(b["embedding"]))
            parts = coder.parts(signs)
            codes = [x.tobytes() for x in np.packbits(signs, axis=1, bitorder="little")]
            offsets = pa.array(np.arange(0, parts.size + 1, coder.tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b["rep"], b["kind"], pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(parts.astype(np.int32).ravel()))],
                ["rep", "kind", "code", "parts"],
            )

    return coded


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _distances(codes: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs of packed codes."""
    words = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    words[:, : codes.shape[1]] = codes
    words = words.view(np.uint64)
    out = np.zeros((len(codes), len(codes)), np.int32)
    for w in words.T:
        out += np.bitwise_count(w[:, None] ^ w[None, :])
    return out


def _near_codes(coder: Coder):
    """Of the members of each bucket, those with another whose code is near."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in by_key(batches, "bucket"):
            if b.num_rows > 1:
                apart = _distances(_codes(b["code"]))
                np.fill_diagonal(apart, coder.far + 1)
                yield b.filter(pa.array((apart <= coder.far).any(axis=1))).select(["bucket", "rep", "place"])

    return near


def _linked(coder: Coder, least: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in by_key(batches, "group"):
            x = unit_rows(b["embedding"])
            rep, copies, kind, part = (b[c].to_numpy() for c in ("rep", "copies", "kind", "part"))
            near = (x @ x.T >= least) & (kind[:, None] == kind[None, :])
            np.fill_diagonal(near, False)
            if b["low"][0].as_py() != b["high"][0].as_py():
                near &= part[:, None] != part[None, :]
            codes, place = _codes(b["code"]), int(b["place"][0].as_py())
            i, j = np.nonzero(near)
            # counts and components take the same pairs: those whose codes are near, in whichever bucket they meet
            close = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1, dtype=np.int64) <= coder.far
            near[i[~close], j[~close]] = False
            i, j = i[close], j[close]
            if not i.size:
                continue
            signs = np.unpackbits(codes, axis=1, count=coder.bits * coder.tables, bitorder="little")
            seen = coder.parts(signs)[:, :place]
            # a pair counts where it first meets
            first = ~(seen[i] == seen[j]).any(axis=1)
            count = np.bincount(i[first], weights=copies[j[first]], minlength=rep.size).astype(np.int64)
            root = np.arange(rep.size)
            while True:
                low = root.copy()
                np.minimum.at(low, i, root[j])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            any_link = near.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[any_link]), pa.array(count[any_link]), pa.array(rep[root[any_link]])], ["node", "n", "root"]
            )

    return linked


def _bucket_links(classes: DataFrame, coder: Coder, least: float, scratch: Scratch, name: str) -> DataFrame:
    """(node, n, root) of vectors that link within a bucket: how many others first meet there, and one of the linked."""
    parts = shuffle_partitions(classes.sparkSession)
    kind = F.xxhash64("label").alias("kind")
    coded = classes.select("rep", kind, "embedding").mapInArrow(_coded(coder), "rep long, kind long, code binary, parts array<int>")
    coded = scratch.save(coded, f"coded{name}")
    keys = coded.select("rep", "kind", "code", F.posexplode("parts").alias("place", "part"))
    keys = keys.select(F.xxhash64("kind", "place", "part").alias("bucket"), "rep", "place", "code")
    crowds = keys.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    crowds = scratch.save(crowds, f"crowds{name}")
    # buckets over BLOCK go on whole, to be compared in blocks
    alone = keys.join(crowds.select("bucket"), "bucket", "left_anti")
    near = alone.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_near_codes(coder), "bucket long, rep long, place int")
    met = near.withColumn("blocks", F.lit(1)).unionByName(keys.join(crowds, "bucket").select("bucket", "rep", "place", "blocks"))
    dealt = (
        met.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        .select("rep", "place", "part", "low", "high", F.xxhash64("bucket", "low", "high").alias("group"))
    )
    vectors = classes.select("rep", "copies", "embedding").join(coded.select("rep", "kind", "code"), "rep")
    got = (
        scratch.save(dealt, f"dealt{name}").join(vectors, "rep").select("group", "rep", "kind", "copies", "embedding", "code", "place", "part", "low", "high")
        .repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_linked(coder, least), "node long, n long, root long")
    )
    got = scratch.save(got, f"got{name}")
    scratch.drop(f"coded{name}", f"crowds{name}", f"dealt{name}")
    return got


def embedding_links(
    vectors: DataFrame, least: float = 0.98, fit_rows: int = 20_000, miss: float = 1e-3, scratch: Scratch | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine is
    at least `least`.  Null, empty or zero vectors and those with null or
    non-finite components link with nothing, nor do rows without a label or
    vec_id, or vectors of different lengths.  Rows with equal label and vector
    link with each other; equal vec_ids are rows of their own.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "hamming")
    kind = vectors.schema["embedding"].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = F.expr(
        "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    )
    # -0 and 0 are one; 128 bits tell vectors apart
    rows = rows.withColumn("embedding", F.expr(f"transform(embedding, x -> x + cast(0 as {element}))")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = scratch.save(rows.withColumn("v1", F.xxhash64("label", "embedding")).withColumn("v2", F.xxhash64(F.lit(1), "embedding", "label")), "rows")
    classes = rows.where("sound").groupBy("label", "embedding", "v1", "v2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("width", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()), "classes")

    out = None
    for width, many in classes.groupBy("width").count().collect():
        own = classes.where(F.col("width") == width)
        share = min(1.0, fit_rows / many)
        sample = own.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").toArrow()
        fit = unit_rows(sample["embedding"].combine_chunks()) if sample.num_rows else np.ones((1, width)) / math.sqrt(width)
        got = _bucket_links(own, plan_codes(fit, many, least, miss), least, scratch, str(width))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "node long, n long, root long")

    roots = scratch.save(connected_components(out.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch), "roots")
    ids = classes.select("rep", "vec_id")
    names = roots.join(ids, roots.node == ids.rep).groupBy("root").agg(F.min("vec_id").alias("component_id"))
    found = out.groupBy("node").agg(F.sum("n").alias("n")).join(roots, "node").join(names, "root").select(F.col("node").alias("rep"), "n", "component_id")
    per_class = classes.join(found, "rep", "left").select(
        "label", "v1", "v2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    per_class = scratch.save(per_class, "per_class")
    named = rows.select("vec_id", "sound", "label", "v1", "v2").alias("r").join(
        per_class.alias("c"), F.expr("r.sound and r.v1 = c.v1 and r.v2 = c.v2 and r.label = c.label"), "left"
    )
    return named.select(
        "r.vec_id", F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c.component_id", "r.vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
