"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so a document's own MinHash says little
about an item inside it.  The search is therefore asymmetric: items are put in
partitions by size, and each is sketched by its bottom k shingle hashes, the
MinHash values that a document holding the item has in its own set.  A
document that holds at least a share t of an item's n shingles misses at most
n - ceil(t * n) of them, so with k one more than that, at least one sketch
value must be in the document's set: no containing pair is missed.
Candidates are verified by the exact count of common shingles.

A partition is skipped where a document has fewer shingles than its smallest
item needs.  In the others, the shorter of the two sorted lists, the document's
shingles or the partition's sketch values, is looked up in the longer.

The benchmark is a stated query set.  It is broadcast in blocks of at most
`block_shingles` shingles, and every block is held against all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import keep_rows
from tidepool.llm.shingles import mix, shingles

_U = np.uint64


class ItemIndex:
    """Sketches of items by size partition, and their whole sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int) -> None:
        self.percent = percent
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.sets = [s for _, s in items]
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by_size.setdefault(s.size.bit_length(), []).append(k)
        self.partitions = []
        for members in by_size.values():
            values, owners = [], []
            for k in members:
                s = self.sets[k]
                enough = s.size - self.needed(s.size) + 1
                values.append(s[np.argsort(mix(s))[:enough]])
                owners.append(np.full(enough, k))
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            self.partitions.append((value[order], owner[order], min(self.needed(self.sets[k].size) for k in members)))

    def needed(self, size: int) -> int:
        """Shingles of an item of `size` that a document must have."""
        return -(-self.percent * size // 100)

    def _owners(self, s: np.ndarray) -> Iterator[int]:
        for value, owner, least in self.partitions:
            if s.size < least:
                continue
            if value.size < s.size:
                at = np.minimum(np.searchsorted(s, value), s.size - 1)
                hits = owner[s[at] == value]
            else:
                low, high = np.searchsorted(value, s), np.searchsorted(value, s, side="right")
                hits = np.concatenate([owner[a:z] for a, z in zip(low[high > low], high[high > low])] or [owner[:0]])
            yield from np.unique(hits).tolist()

    def found(self, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, common shingles) of the items that the sorted set `s` contains."""
        if not s.size:
            return
        for k in self._owners(s):
            whole = self.sets[k]
            at = np.minimum(np.searchsorted(s, whole), s.size - 1)
            common = int(np.count_nonzero(s[at] == whole))
            if common >= self.needed(whole.size):
                yield k, common


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(shingles(b["text"].to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [b["item_id"], pa.array([s.size for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["item_id", "n", "elements"],
        )


def _item_blocks(items: DataFrame, percent: int, block_shingles: int) -> Iterator[Broadcast]:
    """Indexes of all items, in blocks by a hash of item_id that hold about `block_shingles` shingles."""
    spark = items.sparkSession
    sets = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_sets, "item_id long, n long, elements binary"
    ).where("n > 0").persist()
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_shingles))
    for k in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r["item_id"], np.frombuffer(bytes(r["elements"]), _U)) for r in rows], percent))
    sets.unpersist()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, block_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document and item it contains.

    `docs` (doc_id, text), `items` (item_id, text).  An item is contained when
    a document has at least `percent` of the item's distinct five-word
    shingles; a text of one to four words has its whole word sequence as its
    only shingle.  Null and wordless texts on either side match nothing, and a
    null item_id is left out.  Repeated rows on either side give repeated
    results.  Empty tables give no rows; other columns are ignored.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for index in _item_blocks(items, percent, block_shingles):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                hits = [(i, k, c) for i, s in enumerate(shingles(b["text"].to_pylist())) for k, c in ix.found(s)]
                row = pa.array([h[0] for h in hits], pa.int64())
                n = [ix.sets[h[1]].size for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(row), pa.array([int(ix.ids[h[1]]) for h in hits], pa.int64()), pa.array(n, pa.int64()),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([h[2] / m for h, m in zip(hits, n)], pa.float64())],
                    ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

        part = texts.mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long, containment double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, block_shingles: int = 2_000_000) -> DataFrame:
    """The rows of `docs` (with a column text) that contain no item, with all their columns.

    Null and wordless texts contain nothing and stay, as do repeated rows;
    without items all rows stay; an empty table gives no rows.
    """
    for index in _item_blocks(items, percent, block_shingles):

        def test(index=index) -> Callable[[list], list[bool]]:
            return lambda texts: [next(index.value.found(s), None) is None for s in shingles(texts)]

        docs = keep_rows(docs, "text", test)
    return docs
