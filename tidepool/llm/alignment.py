"""How the tokens of two tokenizers lie over each other, and how often each pair of ids does so in the corpus.

Texts are encoded once.  A text is cut where neither tokenizer can join what
stands on both sides (a single space between visible characters), so that
segments that occur again need not be encoded again.  Token ends in bytes then
give groups (both end) and links (ranges overlap).  The distinct pairs get a
minimal perfect hash; counts are dense vectors indexed by it and summed in a
tree; a second pass aligns the documents anew and looks the counts up, with
every key verified.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm.arrow import slices
from tidepool.llm.dense import VECTORS, expanded, tree_sum, vector_rows
from tidepool.llm.minimal_hash import BUCKET, MinimalHash, hash_buckets
from tidepool.llm.shared import Scratch

#: Pairs whose hash and counts are broadcast at once (about 20 bytes each); more go round in several passes.
PAIRS = 4_000_000
#: A cut: a single space between two visible characters of Latin, Greek or Cyrillic.  The byte tokenizer's words begin at
#: such a space, and no piece of the other joins a visible character to a space that follows (checked when it is loaded).
_VISIBLE = "!-~À-ɏͰ-ԯ"
_CUT = re.compile(rf"(?<=[{_VISIBLE}]) (?=[{_VISIBLE}])")
_LETTERS = frozenset(c for c in map(chr, range(0x530)) if re.match(f"[{_VISIBLE}]", c))
#: Characters encoded at a time, segments a task remembers, characters of a text that are cut at a time, tokens aligned at a time, keys held.
_RUN, _SEGMENTS, _PART, _TOKENS, _KEYS = 100_000, 400_000, 1_000_000, 1_000_000, 2_000_000
_SPACE = "▁"


@dataclass
class Vocabulary:
    """The bytes of each id's token."""

    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the rest for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairEncoder:
    """Ids of both tokenizers for texts, by segments."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = _byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.va = Vocabulary([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.cuts = not any(re.search(rf"[{_VISIBLE}]{_SPACE}", p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.starts, self.many, self.sound = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros(0, bool)

    def _run(self, segments: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """(ids of both, tokens of each segment of both, whether its bytes are kept) of segments, encoded as one text.

        Several have to begin and end visibly; the text is halved where its bytes are not kept.
        """
        text = " ".join(segments)
        want = f" {text}".encode()
        ids = (
            np.array(self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text), np.int64),
        )
        if any(b"".join(map(v.tokens.__getitem__, x.tolist())) != want for x, v in zip(ids, (self.va, self.vb))):
            if len(segments) == 1:
                return ids, tuple(np.array([x.size]) for x in ids), np.zeros(1, bool)
            half = len(segments) // 2
            one, two = self._run(segments[:half]), self._run(segments[half:])
            return *(tuple(map(np.concatenate, zip(one[k], two[k]))) for k in (0, 1)), np.r_[one[2], two[2]]
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        many = []
        for x, v in zip(ids, (self.va, self.vb)):
            at = np.cumsum(v.lengths[x])
            k = np.searchsorted(at, ends)
            if (at[k] != ends).any():
                raise ValueError("a token crosses a cut")
            many.append(np.diff(k, prepend=-1))
        return ids, tuple(many), np.ones(len(segments), bool)

    def _learn(self, segments: list[str]) -> None:
        if not segments:
            return
        runs, run, size, odd = [], [], 0, []
        for s in segments:
            if s and s[0] in _LETTERS and s[-1] in _LETTERS:
                run.append(s)
                size += len(s) + 1
                if size > _RUN:
                    runs.append(run)
                    run, size = [], 0
            else:
                odd.append([s])
        runs += [run] * bool(run) + odd
        coded = [self._run(r) for r in runs]
        for side in (0, 1):
            many = np.concatenate([c[1][side] for c in coded])
            self.starts[side] = np.r_[self.starts[side], np.cumsum(many) - many + self.ids[side].size]
            self.many[side] = np.r_[self.many[side], many]
            self.ids[side] = np.concatenate([self.ids[side], *[c[0][side].astype(np.uint16) for c in coded]])
        self.sound = np.concatenate([self.sound, *[c[2] for c in coded]])
        self.known.update(zip((s for r in runs for s in r), range(len(self.known), self.sound.size)))

    def _segments(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > _PART:  # a huge text is cut in parts, at a cut
            m = _CUT.search(text, at + _PART)
            if not m:
                break
            out += _CUT.split(text[at : m.start()])
            at = m.end()
        return out + _CUT.split(text[at:] if at else text)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both ids of each text as bytes of uint16; nothing for empty texts and those whose bytes are not kept."""
        cut = [self._segments(t) if t else [] for t in texts]
        coded = pa.array([s for c in cut for s in c], pa.string()).dictionary_encode()
        if len(self.known) > _SEGMENTS:
            self._forget()
        names = coded.dictionary.to_pylist()
        self._learn([s for s in names if s not in self.known])
        place = np.array([self.known[s] for s in names], np.int64)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
        ends = np.cumsum([len(c) for c in cut]) if cut else np.zeros(0, int)
        bad = np.r_[0, np.cumsum(~self.sound[place])]
        sides = []
        for side in (0, 1):
            many = self.many[side][place]
            upto = np.r_[0, np.cumsum(many)]
            flat = self.ids[side][np.repeat(self.starts[side][place] - upto[:-1], many) + np.arange(upto[-1])]
            sides.append((flat, upto))
        out, begin = [], 0
        for z in ends.tolist():
            if bad[z] > bad[begin] or z == begin:
                out.append((b"", b""))
            else:
                out.append(tuple(flat[upto[begin] : upto[z]].tobytes() for flat, upto in sides))
            begin = z
        return out


def _encoder(shared):
    """A task's encoder; made once in each worker process."""
    if "encoder" not in _loaded or _loaded["key"] != shared.value[2]:
        _loaded.update(key=shared.value[2], encoder=PairEncoder(*shared.value[:2]))
    return _loaded["encoder"]


_loaded: dict = {}


class Aligned:
    """Tokens of some documents, laid over each other; every document's bytes are the same on both sides."""

    def __init__(self, batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> None:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).astype(np.int64) for c in "ab")
        self.many_a, self.many_b = (np.fromiter((len(x) // 2 for x in batch[c].to_pylist()), np.int64, batch.num_rows) for c in "ab")
        # a sign for each byte at which a token of A (1), of B (2) or both (3) end
        signs = np.zeros(int(lengths[0][a].sum()) + 1, np.uint8)
        signs[np.cumsum(lengths[0][a])] = 1
        signs[np.cumsum(lengths[1][b])] |= 2
        marks = signs[signs > 0]
        mark_a, mark_b = (marks & 1).astype(np.int32), (marks >> 1).astype(np.int32)
        # between two neighbouring ends lies one token of each side: a link
        link_a, link_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
        self.a, self.b = a, b
        coded = pa.array((a[link_a] << 32) | b[link_b]).dictionary_encode()
        #: The distinct pairs of ids, and which of them each link is.
        self.keys, self.pair = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        self.doc = np.repeat(np.arange(batch.num_rows), self.many_a)[link_a]
        both = mark_a & mark_b
        self.groups = np.bincount(self.doc[both > 0], minlength=batch.num_rows)
        before = np.cumsum(both) - both
        at_a, at_b = np.flatnonzero(mark_a), np.flatnonzero(mark_b)
        self.group_a, self.group_b = before[at_a], before[at_b]

    def digests(self, names: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups as decimal ids, '' without tokens."""
        table, widths = names
        first_a = np.r_[True, self.group_a[1:] != self.group_a[:-1]] if self.a.size else np.zeros(0, bool)
        first_b = np.r_[True, self.group_b[1:] != self.group_b[:-1]] if self.b.size else np.zeros(0, bool)
        starts = np.cumsum(self.many_a) - self.many_a
        opens = np.zeros(self.a.size, bool)
        opens[starts[self.many_a > 0]] = True
        # the signs before an id: none, `;`, `,` or `|`
        sign = np.r_[np.where(opens, 0, np.where(first_a, 1, 2)), np.where(first_b, 3, 2)]
        order = np.argsort(np.r_[2 * self.group_a, 2 * self.group_b + 1], kind="stable")
        code = (sign * len(widths[0]) + np.r_[self.a, self.b])[order]
        spelled = table[code]
        text = spelled[spelled != 0].tobytes()
        upto = np.r_[0, np.cumsum(widths.reshape(-1)[code])]
        tokens = np.r_[0, np.cumsum(self.many_a + self.many_b)]
        return [hashlib.sha256(text[upto[x] : upto[y]]).hexdigest() if y > x else "" for x, y in zip(tokens[:-1], tokens[1:])]


def _spelled_ids(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of sign and decimal id, padded with zeros; their lengths) for all signs and ids."""
    names = [[f"{s}{i}".encode() for i in range(most)] for s in ("", ";", ",", "|")]
    widths = np.array([[len(x) for x in row] for row in names], np.int64)
    flat = np.array([x for row in names for x in row], f"S{widths.max()}")
    return flat.view(np.uint8).reshape(len(flat), -1), widths


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `_TOKENS` tokens."""
    for b in batches:
        a, size = 0, 0
        for k, n in enumerate((len(x.as_buffer()) for x in b["a"])):
            size += n
            if size > 2 * _TOKENS:
                yield b.slice(a, k + 1 - a)
                a, size = k + 1, 0
        if a < b.num_rows:
            yield b.slice(a)


def _hash_ranges(hashes: DataFrame, buckets: int, pairs: int) -> Iterator[tuple[int, int, MinimalHash]]:
    """The hash function in ranges of buckets of about `pairs` pairs."""
    width = max(1, pairs // BUCKET)
    for low in range(0, buckets, width):
        high = min(buckets, low + width)
        rows = hashes.where(F.col("bucket").between(low, high - 1)).orderBy("bucket").collect()
        yield low, high, MinimalHash.from_rows(rows, buckets, low, high)


def align_tokenizers(docs: DataFrame, byte_json_path: str, piece_model_path: str, scratch: Scratch | None = None, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs` (doc_id, text).

    A is a byte-level tokenizer, which encodes a space and the text; B, a
    piece tokenizer that adds the space itself.  Groups are cut where a token
    of A and one of B both end; a link is a token of A and one of B whose
    bytes overlap.  The count of a pair of ids is the number of its links in
    the corpus.  `n_best` are the links whose pair has the highest count of
    all pairs with its B id, ties included, `count_sum` is the sum of the
    counts over links, and `groups_sha256` is of `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and texts whose bytes a tokenizer does not keep,
    have no tokens: zeros, and '' for the digest.  Repeated rows all count;
    a null doc_id stays null; an empty table gives no rows; other columns are
    ignored.  The vocabulary files are read by the driver and sent to tasks.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "alignment")
    with open(byte_json_path, encoding="utf-8") as f, open(piece_model_path, "rb") as g:
        files = (f.read(), g.read())
    encoder = PairEncoder(*files)
    if max(len(encoder.va.tokens), len(encoder.vb.tokens)) > 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    lengths = (encoder.va.lengths, encoder.vb.lengths)
    many_b = len(encoder.vb.tokens)
    shared = spark.sparkContext.broadcast((*files, hashlib.sha256(files[0].encode() + files[1]).hexdigest()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for b in slices(batches, 100):
            coded = own.encode([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([c[k] for c in coded], pa.binary()) for k in (0, 1))], ["doc_id", "a", "b"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = np.zeros(0, np.int64), [], 0
        for b in _runs(batches):
            fresh.append(Aligned(b, lengths).keys)
            size += fresh[-1].size
            if size > _KEYS:
                held, fresh, size = np.unique(np.concatenate([held, *fresh])), [], 0
                if held.size > _KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])
                    held = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([held, *fresh])))], ["key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = scratch.save(rows.mapInArrow(encode, "doc_id long, a binary, b binary"), "tokens", "zstd")
    found = scratch.save(tokens.select("a", "b").mapInArrow(distinct, "key long").distinct(), "pairs")
    hashes, buckets = hash_buckets(found, found.count())
    hashes = scratch.save(hashes, "hashes")

    def counter(hashed):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = hashed.value
            total = np.zeros(len(own.keys), np.int64)
            for b in _runs(batches):
                x = Aligned(b, lengths)
                mine, slot = own.slots(x.keys)
                total[slot] += np.bincount(x.pair, minlength=x.keys.size)[mine]
            cut = ((own.low + k, total[s : s + n]) for k, (s, n) in enumerate(zip(own.starts, own.sizes)) if total[s : s + n].any())
            yield from vector_rows(cut, TaskContext.get().partitionId())

        return count

    counts = None
    for low, _, hashed in _hash_ranges(hashes, buckets, pairs):
        part = tree_sum(tokens.select("a", "b").mapInArrow(counter(spark.sparkContext.broadcast(hashed)), VECTORS))
        part = scratch.save(part, f"counts-{low}")
        counts = part if counts is None else counts.unionByName(part)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(many_b, np.int64)
        for b in batches:
            for row in b.to_pylist():
                np.maximum.at(most, np.frombuffer(row["keys"], np.int64) & 0xFFFFFFFF, expanded(row))
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], ["b", "most"])

    counted = hashes.select(F.col("bucket").cast("long").alias("block"), "keys").join(counts, "block")
    best = np.zeros(many_b, np.int64)  # one number for each id of B
    for r in counted.mapInArrow(highest, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).collect():
        best[r["b"]] = r["most"]
    names = spark.sparkContext.broadcast(_spelled_ids(max(len(v) for v in lengths)))
    best = spark.sparkContext.broadcast(best)

    def measured(hashed, values):
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, worth = hashed.value, values.value
            for b in _runs(batches):
                x = Aligned(b, lengths)
                mine, slot = own.slots(x.keys)
                count, top = np.zeros(x.keys.size, np.int64), np.zeros(x.keys.size, bool)
                count[mine] = worth[slot]
                top[mine] = worth[slot] == best.value[x.keys[mine] & 0xFFFFFFFF]
                # a document's links stand together
                many = np.bincount(x.doc, minlength=b.num_rows)
                upto = np.r_[0, np.cumsum(many)]
                total, tops = (np.diff(np.r_[0, np.cumsum(v[x.pair].astype(np.int64))][upto]) for v in (count, top))
                columns = [x.many_a, x.many_b, x.groups, many, tops, total]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], *(pa.array(c.astype(np.int64)) for c in columns), pa.array(x.digests(names.value))], ["doc_id", *_MEASURES, "groups_sha256"]
                )

        return measure

    schema = f"doc_id long, {', '.join(f'{c} long' for c in _MEASURES)}, groups_sha256 string"
    out, more = None, None
    for low, high, hashed in _hash_ranges(hashes, buckets, pairs):
        vectors = counts.where(F.col("block").between(low, high - 1)).orderBy("block").collect()
        values = np.concatenate([expanded(r.asDict()) for r in vectors]) if vectors else np.zeros(0, np.int64)
        part = tokens.mapInArrow(measured(*map(spark.sparkContext.broadcast, (hashed, values))), schema)
        if out is None:
            out = part
        else:  # another range of pairs: what it adds is the same for rows of the same id and groups
            part = scratch.save(part.select("doc_id", "groups_sha256", "n_best", "count_sum").distinct(), f"more-{low}")
            more = part if more is None else more.unionByName(part)
    if more is None:
        return out
    more = more.groupBy("doc_id", "groups_sha256").agg(F.sum("n_best").alias("n"), F.sum("count_sum").alias("s"))
    both = out.alias("o").join(more.alias("m"), F.expr("o.doc_id <=> m.doc_id and o.groups_sha256 = m.groups_sha256"), "left")
    added = {"n_best": "n", "count_sum": "s"}
    return both.select(*[(F.col(f"o.{c}") + F.coalesce(f"m.{added[c]}", F.lit(0))).alias(c) if c in added else F.col(f"o.{c}") for c in out.columns])


_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
