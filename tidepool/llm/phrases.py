"""Phrases that occur more often than their parts would suggest, by language.

Words are counted and those that can be part of a frequent phrase are
numbered; texts become arrays of word numbers, once.  Candidates of k words are
Apriori-safe: both their parts of k - 1 words are frequent, and of the
positions at which they begin enough are seen to reach the least count (tasks
send positions up to that count only).  Double-array tries of the candidates
are broadcast in shards of a bounded size; numpy advances the states of all
text positions at once, word by word, and counts accepting states with
bincount; the counts are vectors that are summed in a tree.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.arrow import by_key, slices
from tidepool.llm.dense import VECTORS, blocks_of, mixed, numbered, tree_sum, vector_entries, vector_rows
from tidepool.llm.shared import Scratch, shuffle_partitions
from tidepool.llm.tries import Trie, build_trie

#: Words of the longest phrase.
LONGEST = 4
#: Phrases of a broadcast trie (about 60 bytes each), and words of a broadcast vocabulary; more go round in several passes.
SHARD, VOCABULARY = 1_000_000, 1_000_000
#: Characters of a text that are split into words at a time, and words or keys that a task holds before it sends them.
_PIECE, _HELD_WORDS, _HELD_KEYS, _ROW_WORDS = 500_000, 300_000, 1_500_000, 1 << 16

_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_WORDS = re.compile(r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_W = [f"w{k + 1}" for k in range(LONGEST)]


def _words(text: str) -> Iterator[list[str]]:
    """Words, and separators as words of their own, of a text's pieces; huge texts are cut before spaces."""
    a = 0
    while a < len(text):
        z = a + _PIECE
        z = len(text) if z >= len(text) else (text.find(" ", z) if text.find(" ", z) > 0 else len(text))
        yield _WORDS.findall(text, a, z)
        a = z


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[str]]:
    out = defaultdict(list)
    for lang, text in zip(batch["lang"].to_pylist(), pc.ascii_lower(batch["text"]).to_pylist()):
        out[lang].append(text)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and with a null word the number of all words, counted within the task."""
    held: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            for s in _SEPARATORS:
                counts.pop(s, None)
            words = [None, *counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array([counts.total(), *counts.values()], pa.int64())], ["lang", "word", "n"]
            )
        held.clear()

    for b in slices(batches, 200):
        for lang, texts in _by_lang(b).items():
            for text in texts:
                for words in _words(text):
                    held[lang].update(words)
        if sum(map(len, held.values())) > _HELD_WORDS:
            yield from rows()
    yield from rows()


def _encode(vocabulary: Broadcast, known: bool, keep: bool):
    """Texts as arrays of word numbers, 0 for separators and other words; `known` numbers of an earlier pass stay.

    With `keep`, the texts stay with their numbers for another pass; else
    texts of a language are joined to rows of some tens of thousands of words.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value

        def numbers(texts: list[str], own: dict[str, int]) -> np.ndarray:
            words: list[str] = []
            for t in texts:
                for part in _words(t):
                    words += part
                words.append(_SEPARATORS[0])
            coded = pa.array(words, pa.string()).dictionary_encode()
            table = np.fromiter((own.get(w, 0) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
            return table[coded.indices.to_numpy()] if words else np.zeros(0, np.int32)

        for b in slices(batches, 400):
            if keep or known:
                rows = []
                for k, (lang, text) in enumerate(zip(b["lang"].to_pylist(), pc.ascii_lower(b["text"]).to_pylist())):
                    v = numbers([text], ids.get(lang, {}))
                    if known:
                        v = np.maximum(v, np.frombuffer(b["ids"][k].as_buffer(), np.int32))
                    rows.append(v.tobytes())
                coded = pa.array(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b["lang"], b["text"], coded], ["lang", "text", "ids"]) if keep else pa.RecordBatch.from_arrays([coded], ["ids"])
                continue
            rows = []
            for lang, texts in _by_lang(b).items():
                held, size = [], 0
                for text in [*texts, None]:
                    if held and (text is None or size > 6 * _ROW_WORDS):
                        rows.append(numbers(held, ids.get(lang, {})).tobytes())
                        held, size = [], 0
                    if text is not None:
                        held.append(text)
                        size += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    return encode


def _encoded(texts: DataFrame, words: DataFrame, many: int, scratch: Scratch, block: int) -> DataFrame:
    """(ids) of all texts; a vocabulary over `block` words takes several passes."""
    rows, starts = texts, range(1, many + 1, block) or [1]
    for at in starts:
        ids: dict[str, dict[str, int]] = defaultdict(dict)
        table = words.where(F.col("no").between(at, at + block - 1)).select("lang", "word", "no").toArrow()
        for lang, word, no in zip(*(c.to_pylist() for c in table.columns)):
            ids[lang][word] = no
        last = at + block > many
        shared = texts.sparkSession.sparkContext.broadcast(dict(ids))
        rows = rows.mapInArrow(_encode(shared, at > 1, not last), "ids binary" if last else "lang string, text string, ids binary")
        rows = scratch.save(rows, f"ids-{at}", "zstd")
        if at > 1:
            scratch.drop(f"ids-{at - block}")
    return rows


def _marks(words: np.ndarray, trie: Trie, k: int) -> np.ndarray:
    """At each position, the value of the phrase of k words that starts there, or 0."""
    out = np.zeros(words.size, np.int32)
    for n, at, value in trie.walk(words, k):
        if n == k:
            out[at] = value
    return out


def _mark(trie: Broadcast, k: int):
    """`marks` with those of one more shard of phrases."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids, marks in zip(b["ids"], b["marks"]):
                words, m = (np.frombuffer(x.as_buffer(), np.int32) for x in (ids, marks))
                new = _marks(words, trie.value, k)
                out.append((np.maximum(m, new) if m.size else new).tobytes())
            yield pa.RecordBatch.from_arrays([b["ids"], pa.array(out, pa.binary())], ["ids", "marks"])

    return mark


def _seen(least: int, blocks: int):
    """(block, keys, counts): neighbouring marks, both over 0, as keys of 64 bits, and how often they are seen here, up to `least`."""
    small = np.min_scalar_type(least)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in held]), minlength=keys.size)
        return keys, np.minimum(counts, least).astype(small)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block = (mixed(keys) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        block, keys, counts = block[order], keys[order], counts[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), block.size] if block.size else np.zeros(1, int)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[cuts[:-1]], pa.int32()), pa.array([keys[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([counts[a:z].tobytes() for a, z in spans], pa.binary())],
            ["block", "keys", "counts"],
        )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, all_keys = [], 0, (np.zeros(0, np.int64), np.zeros(0, small))
        for b in batches:
            for x in b["marks"]:
                m = np.frombuffer(x.as_buffer(), np.int32)
                at = np.flatnonzero((m[:-1] > 0) & (m[1:] > 0))
                keys = (m[at].astype(np.int64) << 32) | m[at + 1]
                held.append((keys, np.ones(keys.size, small)))
                fresh += keys.size
                if fresh > 1_000_000:
                    all_keys = merged([all_keys, *held])
                    held, fresh = [], 0
                    if all_keys[0].size > _HELD_KEYS:
                        yield rows(*all_keys)
                        all_keys = (np.zeros(0, np.int64), np.zeros(0, small))
        yield rows(*merged([all_keys, *held]))

    return seen


def _enough(least: int):
    """(before, after) of the keys of each block that were seen `least` times."""
    small = np.min_scalar_type(least)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in by_key(batches, "block"):
            keys, inverse = np.unique(np.frombuffer(b"".join(b["keys"].to_pylist()), np.int64), return_inverse=True)
            counts = np.bincount(inverse, weights=np.frombuffer(b"".join(b["counts"].to_pylist()), small), minlength=keys.size)
            keys = keys[counts >= least]
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)], ["before", "after"])

    return enough


def _tries(phrases: DataFrame, many: int, first: int, scratch: Scratch, name: str, shard: int) -> Iterator[Broadcast]:
    """The tries of phrases (no, w1, ...) numbered from `first`, shard by shard; each is built in a task and has at most `shard` phrases."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in by_key(batches, "shard"):
            words = np.stack([b[w].to_numpy() for w in _W], axis=1)
            row = {"shard": int(at)} | build_trie(words, b["no"].to_numpy()).to_row()
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("root", "base", "check", "value")), ("digits", pa.int32()), ("bits", pa.int32())]))

    count = -(-many // shard)
    dealt = phrases.withColumn("shard", F.floor((F.col("no") - first) / shard)).select("shard", F.col("no").cast("int"), *[F.col(w).cast("int") for w in _W])
    built = dealt.repartition(max(1, count), "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, root binary, base binary, check binary, value binary, digits int, bits int")
    built = scratch.save(built, name)
    for k in range(count):
        # by Arrow, so that the driver holds no copies of the arrays as rows
        table = built.where(F.col("shard") == k).toArrow()
        shared = phrases.sparkSession.sparkContext.broadcast(Trie.from_row({n: table[n][0].as_buffer() if n in ("root", "base", "check", "value") else table[n][0].as_py() for n in table.column_names}))
        del table
        yield shared


def _candidates(ids: DataFrame, shorter: DataFrame | None, many: int, first: int, k: int, least: int, scratch: Scratch, shard: int) -> DataFrame:
    """(before, after) of the phrases of k words both of whose parts of k - 1 words are among `shorter`, and that are seen `least` times."""
    marked = ids.select("ids", F.col("ids").alias("marks"))
    if shorter is not None:
        marked = ids.select("ids", F.lit(b"").alias("marks"))
        for n, trie in enumerate(_tries(shorter, many, first, scratch, f"tries-{k}", shard)):
            if n:  # another shard: what the ones before have marked is kept in a table
                marked = scratch.save(marked, f"marked-{k}-{n}", "zstd")
            marked = marked.mapInArrow(_mark(trie, k - 1), "ids binary, marks binary")
    parts = shuffle_partitions(ids.sparkSession)
    seen = marked.select("marks").mapInArrow(_seen(least, 4 * parts), "block int, keys binary, counts binary")
    return seen.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_enough(least), "before long, after long")


def _counter(trie: Broadcast, first: int, many: int):
    """The vector of how often each phrase of a shard, numbered from `first`, occurs in the task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for b in batches:
            for x in b["ids"]:
                for _, _, value in trie.value.walk(np.frombuffer(x.as_buffer(), np.int32), LONGEST):
                    total += np.bincount(value[value > 0] - first, minlength=many) if value.any() else 0
        yield from vector_rows(blocks_of(total), TaskContext.get().partitionId())

    return count


def _key(columns: list[str]) -> F.Column:
    return F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(w) for c, w in zip(columns, _W)])


def _parts(phrases: DataFrame) -> DataFrame:
    """(no, a, cut, left, right) for every way to cut a phrase in two."""
    nothing = F.lit(0)
    cuts = [
        F.when(F.col("k") > j, F.struct(
            F.lit(j).alias("cut"), F.struct(*[(F.col(w) if n < j else nothing).cast("int").alias(w) for n, w in enumerate(_W)]).alias("left"),
            F.struct(*[(F.col(_W[n + j]) if n + j < LONGEST else nothing).cast("int").alias(w) for n, w in enumerate(_W)]).alias("right"),
        ))
        for j in range(1, LONGEST)
    ]
    return phrases.select("no", "a", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select("no", "a", "c.*")


def _inside(phrases: DataFrame) -> DataFrame:
    """(words, longer): the shorter phrases inside of each phrase, and the highest count of those that hold them."""
    spans = [(a, n) for n in range(2, LONGEST) for a in range(LONGEST - n + 1)]
    inner = [
        F.when((F.col("k") >= a + n) & (F.col("k") > n), F.struct(*[(F.col(_W[a + m]) if m < n else F.lit(0)).cast("int").alias(w) for m, w in enumerate(_W)]))
        for a, n in spans
    ]
    rows = phrases.where("k > 2").select("a", F.explode(F.filter(F.array(*inner), lambda c: c.isNotNull())).alias("words"))
    return rows.groupBy("words").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scratch: Scratch | None = None, shard: int = SHARD, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to 4 words of each lang of `docs` (text, lang).

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and
    these into words at spaces and tabs.  `a` is how often the phrase occurs
    within pieces of its lang, `least` or more; cut in two, its parts occur `l`
    and `r` times and it scores floor(2000000 * a / (l + r)); the cut with the
    lowest score counts, the first of equal ones.  `n` is the number of the
    lang's words.  A phrase goes if one that holds it and has `least` or more
    occurs at least 80 % as often.  Order: score, `a`, then phrase.

    Null texts count as empty, a null lang as `und`; repeated rows all count;
    other columns are ignored; an empty table, or one without such phrases,
    gives no rows.  Texts are taken whole, and counts are exact.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted.where((F.col("n") >= least) | F.col("word").isNull()), "counted")
    totals = counted.where("word is null").select("lang", "n")
    words, many = numbered(counted.where("word is not null"), scratch, "words")
    ids = _encoded(texts, words, many, scratch, vocabulary)

    levels, shorter, count, first = [], None, 0, 1
    for k in range(2, LONGEST + 1):
        pairs = _candidates(ids, shorter, count, first, k, least, scratch, shard)
        if shorter is None:
            rows = pairs.select(F.col("before").alias("w1"), F.col("after").alias("w2"), *[F.lit(0).alias(w) for w in _W[2:]])
        else:
            pairs = scratch.save(pairs, f"pairs-{k}")
            left = shorter.select(F.col("no").alias("before"), *_W[: k - 1])
            right = shorter.select(F.col("no").alias("after"), F.col(_W[k - 2]).alias(_W[k - 1]))
            rows = pairs.join(left, "before").join(right, "after").select(*_W[:k], *[F.lit(0).alias(w) for w in _W[k:]])
        first += count
        shorter, count = numbered(rows.select(F.lit(k).alias("k"), *[F.col(w).cast("int").alias(w) for w in _W]), scratch, f"phrases-{k}", first)
        levels.append(shorter)
        if not count:
            break
    phrases, many = levels[0], first + count - 1
    for more in levels[1:]:
        phrases = phrases.unionByName(more)

    found = spark.createDataFrame([], "no long, n long")
    for at, trie in zip(range(1, many + 1, shard), _tries(phrases, many, 1, scratch, "tries", shard)):
        vectors = tree_sum(ids.mapInArrow(_counter(trie, at, min(shard, many + 1 - at)), VECTORS))
        found = found.unionByName(scratch.save(vector_entries(vectors, at), f"found-{at}"))
    phrases = scratch.save(phrases.join(found.withColumnRenamed("n", "a"), "no"), "counted-phrases")

    single = words.select(F.struct(F.col("no").cast("int").alias("w1"), *[F.lit(0).alias(w) for w in _W[1:]]).alias("words"), "n")
    known = single.unionByName(phrases.select(_key(_W).alias("words"), F.col("a").alias("n")))
    parts = _parts(phrases).join(known.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = parts.groupBy("no").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")).select("no", "best.*")
    kept = phrases.withColumn("words", _key(_W)).join(_inside(phrases), "words", "left")
    kept = kept.where("longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80").join(best, "no")
    kept = kept.join(words.select(F.col("no").alias("w1"), "lang", F.col("word").alias("word1")), "w1")
    # first by numbers alone, ties included, so that few phrases need their words
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    for k in range(2, LONGEST + 1):
        kept = kept.join(words.select(F.col("no").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"word{k + 1}" for k in range(LONGEST)]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", *[F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")]
    )
