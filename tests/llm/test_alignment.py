"""Alignments against a plain version that encodes whole texts with the libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm.alignment import PairEncoder, align_tokenizers
from tidepool.llm.minimal_hash import BUCKET, MinimalHash, buckets_of, solve

DATA = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = {}, 0
    for b in range(256):
        out[chr(b) if b in plain else chr(256 + n)] = b
        n += b not in plain
    return out


LETTERS = letters()


def plain_tokens(texts):
    """[(ids, bytes) of A, (ids, bytes) of B] of each text, or None."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        want = (" " + t).encode()
        out.append([(ia, ba), (ib, bb)] if b"".join(ba) == want and b"".join(bb) == want else None)
    return out


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain_alignment(texts):
    coded = plain_tokens(texts)
    links, count = [], Counter()
    for c in coded:
        own = []
        if c:
            (ia, ba), (ib, bb) = c
            sa, sb, j = spans(ba), spans(bb), 0
            for i, (s, e) in enumerate(sa):
                while sb[j][1] <= s:
                    j += 1
                k = j
                while k < len(sb) and sb[k][0] < e:
                    own.append((ia[i], ib[k]))
                    k += 1
        links.append(own)
        count.update(own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for c, own in zip(coded, links):
        if not c:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (ia, ba), (ib, bb) = c
        ea, eb = [e for _, e in spans(ba)], [e for _, e in spans(bb)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            x, y = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            i, j = x, y
        rows.append((len(ia), len(ib), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


ODD = [
    None, "", " ", "  a", "a  ", "\n", "a\n\n b", "x \n y", "word word word", "<s> </s> <unk> <|endoftext|>", "▁ a", "a ▁", "\x00\x01 a", "日本語 テキスト 本", "é é   　 x",
    "I'll we've don't 's 'S", "1 2 345 6,789.01", "a\tb\r\nc", "🙂 🙂🙂 x🙂", "ﬁ ﬂ ① Ⅷ", "a" * 3000, "ab " * 4000, " " * 700 + "x", "́ b", "ω ж Ω", "a​b ​ c", "﻿a b", "a\x85b \x85 c", "x\x1c y \x1c z",
    "Ͱ ԯ ɏ", "é" * 500, "https://x.y/?a=b&c=d #tag @me", "word word word",
]


def check(got, texts):
    want = plain_alignment(texts)
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    for k, w in enumerate(want):
        assert rows[k] == w, repr(texts[k])[:80]
    assert len(rows) == len(texts)


@pytest.mark.parametrize("pairs", [10**6, 1])
def test_odd_texts_match_a_plain_alignment(spark, pairs):
    """With all pairs at once, and in ranges of one bucket."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("TOKENS", F.lit(1)).repartition(3)
    check(align_tokenizers(docs, *PATHS, pairs=pairs), ODD)


def test_ranges_of_pairs_add_up(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    one, many = (align_tokenizers(docs, *PATHS, pairs=n).collect() for n in (10**7, 1))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == docs.count()


def test_query_matches_a_plain_alignment(spark):
    import __spark_entry__ as driver

    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in driver.queries()["op12_alignment"](spark, DATA).collect()}
    want = plain_alignment([r.text for r in docs])
    assert [tuple(got[r.doc_id])[1:] for r in docs] == want and len(got) == len(docs)


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    only = align_tokenizers(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), *PATHS).collect()
    assert [tuple(r)[1:] for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_huge_texts_are_cut_at_safe_places(monkeypatch):
    import tidepool.llm.alignment as module

    monkeypatch.setattr(module, "_PART", 50)
    monkeypatch.setattr(module, "_RUN", 40)
    monkeypatch.setattr(module, "_SEGMENTS", 20)
    own = PairEncoder(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    texts = [" ".join(t for t in ODD if t), "one two  three\n" * 50, " ".join(f"w{k}" for k in range(500)), ODD[20]]
    texts = [t.replace("▁", "") for t in texts]
    for (a, b), want in zip([x for t in texts for x in own.encode([t])], plain_tokens(texts)):
        assert np.frombuffer(a, np.uint16).tolist() == want[0][0] and np.frombuffer(b, np.uint16).tolist() == want[1][0]


@pytest.mark.parametrize("n", [1, 2, 5, 300, 20_000])
def test_minimal_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 50, n))
    buckets = -(-len(keys) // BUCKET)
    own, rows = buckets_of(keys, buckets), []
    for k in range(buckets):
        seed, slots, moves = solve(keys[own == k])
        rows.append({"bucket": k, "seed": seed, "keys": slots.tobytes(), "moves": moves.tobytes()})
    hashed = MinimalHash.from_rows(rows, buckets, 0, buckets)
    mine, slot = hashed.slots(keys)
    assert mine.size == keys.size and sorted(slot) == list(range(keys.size))
    with pytest.raises(KeyError):
        hashed.slots(keys[:1] + (1 << 51))
    low = MinimalHash.from_rows(rows[:1], buckets, 0, 1)
    assert low.slots(keys)[0].tolist() == np.flatnonzero(own == 0).tolist()
