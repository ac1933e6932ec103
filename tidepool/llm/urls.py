"""URL filters: a blocked Bloom filter, then an exact hash join.

A rule is a host and the beginning of a path, and fits the host, all its
subdomains and every path that starts so.  A url therefore has a bounded set of
possible rules: each suffix of its host at a dot, of no more labels than the
listed host with the most, with each beginning of its path that has the length
of some listed path.  The listed hosts and rules are hashed into a blocked
Bloom filter, whose one 512-bit block per name costs a url one cache line per
probe: suffixes go first, and beginnings of the path only with those that pass.
The few combinations that pass, too, go to an exact hash join with the list,
which removes false positives, and the longest rule wins.  Urls without any go
round the join.

The filter is built by a grouped OR over blocks.  Its size is checked against
`max_filter_bytes`; a longer list gets a filter of that size with more false
positives, which the exact join removes all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch

_WORDS = 8
_PROBES = 6
#: The list is broadcast for the exact join up to this many rules.
BROADCAST_RULES = 100_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in (rest.find("/"), rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((k for k in (tail.find("?"), tail.find("#")) if k >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def suffixes(host: str, labels: int) -> Iterator[str]:
    """The last labels of a host, one to `labels` of them."""
    at = len(host)
    for _ in range(labels if host else 0):
        at = host.rfind(".", 0, at)
        yield host[at + 1 :]
        if at < 0:
            return


def _hash_pair(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    a = pd.util.hash_array(np.array(names, dtype=object), hash_key="0123456789abcdef", categorize=False)
    b = pd.util.hash_array(np.array(names, dtype=object), hash_key="fedcba9876543210", categorize=False)
    return a.astype(np.uint64), b.astype(np.uint64)


def _positions(names: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each name and its bits within it."""
    a, b = _hash_pair(names)
    block = (a % np.uint64(blocks)).astype(np.int64)
    bits = np.stack([(b >> np.uint64(9 * k)) & np.uint64(511) for k in range(_PROBES)], axis=1).astype(np.int64)
    return block, bits


class BlockedBloom:
    """Blocks of 512 bits; a name's bits all lie in one block."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def passes(self, names: list[str]) -> np.ndarray:
        if not names:
            return np.zeros(0, bool)
        block, bits = _positions(names, len(self.words))
        word = self.words[block[:, None], bits >> 6]
        return ((word >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def build_filter(rules: DataFrame, count: int, bits_per_rule: int, max_filter_bytes: int) -> BlockedBloom:
    """The filter of a column `rule`; its blocks are OR-ed together by Spark."""
    blocks = max(1, min(-(-count * bits_per_rule // 512), max_filter_bytes // 64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, bits = _positions(b["rule"].to_pylist(), blocks) if b.num_rows else (np.zeros(0, np.int64), np.zeros((0, _PROBES), np.int64))
            one = np.zeros((len(block), _WORDS), dtype=np.uint64)
            for k in range(_PROBES):
                one[np.arange(len(block)), bits[:, k] >> 6] |= np.uint64(1) << (bits[:, k] & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(one[:, k].view(np.int64)) for k in range(_WORDS)]], ["block", *[f"w{k}" for k in range(_WORDS)]])

    schema = "block long, " + ", ".join(f"w{k} long" for k in range(_WORDS))
    filled = rules.mapInArrow(rows, schema).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)]).toArrow()
    words = np.zeros((blocks, _WORDS), dtype=np.uint64)
    for k in range(_WORDS):
        words[filled["block"].to_numpy(), k] = filled[f"w{k}"].to_numpy().view(np.uint64)
    return BlockedBloom(words)


def filter_urls(
    pages: DataFrame, rules: DataFrame, otherwise: str = "allow", bits_per_rule: int = 16, max_filter_bytes: int = 64_000_000, scratch: Scratch | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url).

    `rules` (host, path, verdict): path starts with `/` and may be just that;
    the host's A-Z are lower-cased, rows with null columns are ignored, and of
    rules that are listed twice the smallest verdict holds.  `rule` is host and
    path of the longest fitting rule, or null; `verdict` is the rule's, else
    `otherwise`.  A null url or one without `://` has an empty host and path
    and fits no rule.  Repeated rows stay; an empty table gives no rows.
    """
    spark = pages.sparkSession
    listed = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("\n"), "path").alias("rule"), "verdict", F.length("path").alias("n")
    ).groupBy("rule").agg(F.min("verdict").alias("verdict"), F.first("n").alias("n"))
    lengths = [r["n"] for r in listed.select("n").distinct().orderBy("n").collect()]
    host = F.substring_index("rule", "\n", 1)
    count, labels = listed.agg(F.count("*"), F.max(F.size(F.split(host, "[.]")))).first()
    names = listed.select("rule").unionByName(listed.select(host.alias("rule")).distinct())
    bloom = spark.sparkContext.broadcast(build_filter(names, 2 * count, bits_per_rule, max_filter_bytes))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, ends, owner = [], [], [], []
            for i, url in enumerate(b["url"].to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                found = list(suffixes(host, labels or 0)) if path else []
                ends += found
                owner += [i] * len(found)
            listed_ends = np.flatnonzero(bloom.value.passes(ends)).tolist()
            combined = [(owner[k], f"{ends[k]}\n{paths[owner[k]][:n]}") for k in listed_ends for n in lengths if n <= len(paths[owner[k]])]
            kept: list[list[str]] = [[] for _ in hosts]
            for k in np.flatnonzero(bloom.value.passes([name for _, name in combined])).tolist():
                kept[combined[k][0]].append(combined[k][1])
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kept, pa.list_(pa.string()))],
                ["page_id", "host", "path", "possible"],
            )

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(
        hits, "page_id long, host string, path string, possible array<string>"
    ).withColumn("row", F.monotonically_increasing_id())
    found = (scratch or Scratch(spark, "urls")).save(found, "found")
    table = listed.select("rule", "verdict")
    table = F.broadcast(table) if count <= BROADCAST_RULES else table
    best = (
        found.where("size(possible) > 0").select("row", F.explode("possible").alias("rule")).join(table, "rule")
        .groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    )
    fits = found.where("size(possible) > 0").join(best, "row", "left").select(F.struct("page_id", "host", "path").alias("page"), "best")
    fits = fits.unionByName(found.where("size(possible) = 0").select(F.struct("page_id", "host", "path").alias("page")), allowMissingColumns=True)
    return fits.select(
        "page.page_id", "page.host", "page.path", F.translate("best.rule", "\n", "").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
