"""Jaccard join, decontamination and embedding links against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.llm.decontamination import ItemIndex, contained_items, drop_contaminated
from tidepool.llm.hamming import embedding_links, pairs_at, plan_codes
from tidepool.llm.jaccard import THIN_ROUNDS, block_keys, jaccard_components, keep_one_of_each, parity_sketch
from tidepool.llm.shared import Scratch
from tidepool.llm.shingles import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    root = components(list(sets), links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = {}
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:  # a copy of another, with some words changed
            w = texts[rng.choice(list(texts))].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 250]))]
            if kind > 0.8:
                w += passage
        texts[i] = rng.choice([" ", "\n", "  "]).join(w)
    return texts


@given(st.lists(st.text(alphabet="aB é\t\n.", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles_match_plain_sets(texts):
    got = list(shingles([*texts, None]))
    assert [s.size for s in got] == [len(plain_set(t)) for t in [*texts, None]]
    for a, s in zip(texts, got):
        for b, t in zip(texts, got):
            assert np.intersect1d(s, t).size == len(plain_set(a) & plain_set(b))


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(x.size) < 0.9], rng.integers(0, 1 << 63, 9, dtype=np.uint64))))
        far = int(np.bitwise_count(parity_sketch(x, 256) ^ parity_sketch(y, 256)).sum())
        assert far <= np.setxor1d(x, y).size


def test_linked_sets_share_the_keys_they_need():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 7, 9, 14, 15, 16, 31, 33, 60, 130, 500):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            y = np.unique(np.concatenate((x[rng.random(x.size) < 0.93], rng.integers(0, 1 << 63, rng.integers(0, n // 10 + 2), dtype=np.uint64))))
            common = np.intersect1d(x, y).size
            if not y.size or 100 * common < 75 * (x.size + y.size - common) or np.array_equal(x, y):
                continue
            a, b = ({v: (set(k.tolist()), need) for v, k, need in block_keys(s)} for s in (x, y))
            assert any(len(a[v][0] & b[v][0]) >= max(a[v][1], b[v][1]) for v in a.keys() & b.keys())


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed):
    texts = corpus(seed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(rows).collect()}
    assert got == brute(texts)


def test_jaccard_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr("tidepool.llm.jaccard.BLOCK", 7)
    base = [f"x{k}" for k in range(60)]
    texts = {i: " ".join(base[:k] + [f"y{i}"] + base[k + 1 :]) for i, k in enumerate(random.Random(5).choices(range(60), k=60))}
    texts |= {100 + i: " ".join(base) for i in range(20)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(rows).collect()}
    assert got == brute(texts)


def test_jaccard_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", None), (None, "one two three four five six", "c"), (5, "one two three four five six", "d"), (5, "one two three four five six", "d"), (7, "ONE two three four five SIX", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5)], key=str)
    assert jaccard_components(df.limit(0)).collect() == []
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "None"]


def test_sets_that_share_half_a_fingerprint_stay_apart(spark):
    texts = corpus(4, 90) | {900: None, 901: " "}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(rows, fingerprint_bits=4).collect()}
    assert got == brute(texts)


def test_jaccard_repeats_are_one_vertex(spark):
    base = [f"x{k}" for k in range(40)]
    a, b = " ".join(base), " ".join(base[:-1] + ["y"])
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(1, a), (1, b)] * 500 + [(2, a.upper()), (2, "other words that stand here")], "doc_id long, text string")
    got = jaccard_components(df, scratch).collect()
    assert len(got) == 1002 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (2, 2)}
    links = spark.read.parquet(f"{scratch.root}/links{THIN_ROUNDS - 1}").unionByName(spark.read.parquet(f"{scratch.root}/more"))
    assert links.count() <= 3


def test_one_row_of_each_component_stays(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (5, b.upper(), 5), (6, "", 6), (6, None, 7), (6, None, 8), (None, a, 9), (7, b, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rows int").withColumnsRenamed({"_rows": "KEPT_rows"}).selectExpr("*", "1 as _rows", "2 as `a.b`", "3 as node", "4 as kept_doc")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (6, ""), (6, ""), (None, a)], key=str)
    assert keep_one_of_each(df.limit(0)).collect() == []


def test_very_long_texts_in_joins(spark):
    rng = random.Random(11)
    long = [f"v{rng.randrange(3000)}" for _ in range(200_000)]
    near = [w if rng.random() > 0.02 else "z" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:150_000])), (4, "x" * 1_500_000), (5, " ".join(long[777:800]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == brute(dict(rows))
    found = contained_items(df, df.where("doc_id = 5").withColumnRenamed("doc_id", "item_id"))
    assert {1, 3, 5} <= {r.doc_id for r in found.collect()} <= {1, 2, 3, 5}


def test_contained_items_match_brute_force(spark):
    rng = random.Random(9)
    texts = {i: t for i, t in corpus(3).items()}
    items = {k: " ".join(w[a : a + rng.choice([3, 9, 14, 30])]) for k, w in enumerate(t.split() for t in texts.values()) for a in [rng.randrange(max(1, len(w) - 8))] if k % 4 == 0}
    want = {
        (d, i, len(plain_set(v)), len(plain_set(t) & plain_set(v)))
        for d, t in texts.items() for i, v in items.items() if plain_set(v) and 100 * len(plain_set(t) & plain_set(v)) >= 75 * len(plain_set(v))
    }
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts.items()] + [(900, None, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items.items(), (800, None), (None, "a b c d e f")], "item_id long, text string")
    for block in (2_000_000, 60):
        got = {tuple(r)[:4] for r in contained_items(docs, bench, block_shingles=block).collect()}
        assert got == want and want
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {*texts, 900} - {w[0] for w in want}
    assert contained_items(docs, bench.limit(0)).collect() == [] and contained_items(docs.limit(0), bench).collect() == []


def test_item_index_has_a_sketch_for_each_size():
    s = np.arange(1, 41, dtype=np.uint64)
    index = ItemIndex([(1, s), (2, s[:3])], 75)
    assert [p[0].size for p in index.partitions] == [11, 1]
    assert list(index.found(s[10:])) == [(0, 30)]


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([centre[rng.integers(0, 12, 150)] + rng.normal(size=(150, 16)) * 0.13, rng.normal(size=(60, 16))]).astype(np.float32)
    x[5] = x[6]
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, x[0].tolist(), None), (1005, [], 0), (1006, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = components(range(len(x)), list(zip(*np.nonzero(near))))
    want = {i: (int(near[i].sum()), int(root[i]), root[i] == i) for i in range(len(x))} | {r[0]: (0, r[0], True) for r in odd}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect()}
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in got) and found >= 0.99 * all_links
    assert found < all_links or got == want
    assert embedding_links(df.limit(0)).collect() == []


def test_codes_are_balanced_beside_a_large_group_of_copies():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2000, 32)) + 1.0, rng.normal(size=32) + 1.0 + rng.normal(size=(1000, 32)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = plan_codes(x, 10_000_000, 0.98, 1e-3)
    signs = coder.signs(x)
    share = signs[:2000].mean(axis=0)
    assert share.min() > 0.25 and share.max() < 0.75 and abs(share.mean() - 0.5) < 0.05
    group = signs[2000:]
    assert np.minimum(group.mean(axis=0), 1 - group.mean(axis=0)).mean() < 0.05  # the copies' codes agree
    a, b = pairs_at(x, 0.98, seed=99)
    one, two = coder.signs(a), coder.signs(b)
    met = (coder.parts(one) == coder.parts(two)).any(axis=1) & ((one != two).sum(axis=1) <= coder.far)
    assert met.mean() >= 0.995


def test_embedding_edge_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [1.0, -0.0], 3), (2, [2.0, 0.01], 3), (None, [1.0, 0.0], 3)], "vec_id long, embedding array<double>, label int")
    df = df.selectExpr("*", "1 as rep", "'x' as kind", "2 as n_links", "3 as code", "4 as V1")
    assert sorted(map(str, map(tuple, embedding_links(df).collect()))) == ["(1, 2, 1, True)", "(2, 2, 1, False)", "(2, 2, 1, False)", "(None, 0, None, False)"]


def test_embedding_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr("tidepool.llm.hamming.BLOCK", 5)
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 1e-4).tolist(), 1) for i in range(30)] + [(100 + i, base.tolist(), 1) for i in range(9)]
    got = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(38, 0)}


def test_plans_that_need_too_many_tables_are_refused(monkeypatch):
    import tidepool.llm.hamming as module

    monkeypatch.setattr(module, "MOST_TABLES", 9)
    x = np.random.default_rng(0).normal(size=(500, 64))
    with pytest.raises(ValueError, match="tables"):
        module.plan_codes(x / np.linalg.norm(x, axis=1, keepdims=True), 10_000_000, 0.5, 1e-3)
