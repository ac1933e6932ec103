"""Phrases against a plain count, tries against a dictionary, and sums in a tree."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.dense import BLOCK, VECTORS, blocks_of, numbered, tree_sum, vector_entries, vector_rows
from tidepool.llm.phrases import collocations
from tidepool.llm.shared import Scratch
from tidepool.llm.tries import build_trie


def plain_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def sample_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "a", "ab", "a\x01", "é", "É", "x y", "日本", "b-c", "'q'", "<s>", "\x1f", "z" * 40]
    fixed = ["new york city", "in the end of", "a ab a ab a ab a", "z é é é"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?! "]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), ("   ", None), ("only once here", "es"), *[("Copy of a text, copy of a text", "en")] * 9]


@pytest.mark.parametrize("seed,shard,vocabulary,top", [(1, 10**6, 10**6, 2000), (2, 3, 4, 2000), (3, 7, 10**6, 5)])
def test_collocations_match_a_plain_count(spark, seed, shard, vocabulary, top):
    """With everything in one shard, and with tries of few phrases and vocabularies of few words."""
    rows = sample_rows(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("WORD", F.lit(0)).withColumn("no", F.lit("x")).repartition(3)
    got = collocations(docs, least=6, top=top, shard=shard, vocabulary=vocabulary)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 6, top)


def test_huge_texts_are_taken_whole(spark):
    text = "red sea blue sky " * 60_000 + "red " * 3
    got = collocations(spark.createDataFrame([(text, "en")], "text string, lang string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases([(text, "en")], 30, 2000)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two three", "en")]])
def test_nothing_to_find(spark, rows):
    got = collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.collect() == []


@pytest.mark.parametrize("n,words,longest", [(1, 1, 4), (40, 3, 4), (3000, 60, 4), (3000, 100_000, 3)])
def test_tries_find_what_a_dictionary_does(n, words, longest):
    rng = np.random.default_rng(n)
    phrases = np.minimum(rng.zipf(1.3, (n, 4)), words)
    many = rng.integers(1, longest + 1, n)
    for k in range(4):
        phrases[many <= k, k] = 0
    phrases = np.unique(phrases, axis=0).astype(np.int32)
    values = rng.permutation(len(phrases)) + 1
    text = np.minimum(rng.zipf(1.3, 4000), words + 2).astype(np.int32)
    text[rng.random(text.size) < 0.1] = 0
    table = {tuple(int(x) for x in p if x): int(v) for p, v in zip(phrases, values)}
    got = {(int(a), k): int(v) for k, at, value in build_trie(phrases, values).walk(text, 4) for a, v in zip(at, value) if v}
    assert got == {(a, k): table[p] for a in range(text.size) for k in range(1, 5) for p in [tuple(text[a : a + k].tolist())] if len(p) == k and p in table}


def test_vectors_add_up(spark):
    rng = np.random.default_rng(0)
    vectors = [np.where(rng.random(3 * BLOCK + 7) < share, rng.integers(1, 1 << 40, 3 * BLOCK + 7), 0) for share in (0.9, 0.01, 0.2, 0, 0.5)] * 7
    rows = [r for k, v in enumerate(vectors) for b in vector_rows(blocks_of(v), k) for r in b.to_pylist()]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], VECTORS).repartition(5)
    got = {r.no: r.n for r in vector_entries(tree_sum(df), 1).collect()}
    total = sum(vectors)
    assert got == {k + 1: int(x) for k, x in enumerate(total) if x}


def test_numbers_have_no_gaps(spark):
    rows, n = numbered(spark.range(1000).repartition(7).where("id % 3 = 0"), Scratch(spark, "t"), "rows", 5)
    assert n == 334 and sorted(r.no for r in rows.collect()) == list(range(5, 339))
    rows, n = numbered(spark.range(0), Scratch(spark, "t"), "none")
    assert n == 0 and rows.columns == ["id", "no"] and rows.count() == 0
