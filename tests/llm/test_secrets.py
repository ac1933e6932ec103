"""Secrets: patterns against plain regular expressions, the field against enumeration, and planted ones."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.secret_spans import BEGIN, INSIDE, OUTSIDE, WINDOW, Field, base_spans, fit_field, model_spans, scan_secrets, train_field

DATA = "/root/testdata/sf0.01"


def plain_base(text):
    kinds = (
        ("assign", re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), k, m.end(), name) for k, (name, rule, holds) in enumerate(kinds) for m in rule.finditer(text or "") if holds(m)]
    return [f"{name}:{a}:{z}" for a, _, z, name in sorted(out)]


def odd_texts():
    rng = random.Random(3)
    parts = ["token", "Token", "toKen", "passſword", "secret", "api_key", "apikey", "API_KEY", "=", ":", " ", "  ", '"', "'", "abcde", "abcdef", "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "Z" * 15,
             "0a" * 12, "f" * 23, "é", "\n", "日本", "A" * 30, "x=y", "=", ".", "-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(1500)] + ["token:token: abcdef", "AKIAAKIA" + "1" * 12, "secret=token=abcdef", "ab" * 500_000]


def test_patterns_match_plain_expressions():
    for t in odd_texts():
        kinds = ("assign", "access", "hex")
        assert [f"{kinds[k]}:{a}:{z}" for a, k, z in base_spans(t)] == plain_base(t), t[:200]


def test_best_tags_match_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(150):
        model = Field({}, rng.normal(size=(3, 3)) * 2)
        n = int(rng.integers(1, 8))
        scores = rng.normal(size=(n, 3)) * 3
        scores[:, OUTSIDE] += rng.choice([0, 6, 12], n)
        rows = np.concatenate([[[-1e9, -1e9, 0.0]], scores, [[-1e9, -1e9, 0.0]]])

        def worth(tags):
            path = [OUTSIDE, *tags, OUTSIDE]
            return sum(scores[k][t] for k, t in enumerate(tags)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=n), key=worth)
        got = model.best_tags(rows)
        assert got[0] == got[-1] == OUTSIDE and worth(tuple(got[1:-1])) == pytest.approx(worth(best))
    # many runs of different lengths at once
    model = Field({}, np.array([[0.5, 2.0, 0.0], [0.0, 1.5, 0.5], [0.0, -3.0, 1.0]]))
    rows = rng.normal(size=(4000, 3)) * 4
    rows[rng.random(4000) < 0.3] = (-1e9, -1e9, 0.0)
    rows[[0, -1]] = (-1e9, -1e9, 0.0)
    best, back = rows[0] + model.moves[OUTSIDE], []
    for r in rows[1:]:
        paths = best[:, None] + model.moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + r
    tag = int((best + model.moves[:, OUTSIDE]).argmax())
    want = [tag]
    for b in reversed(back):
        want.append(int(b[want[-1]]))
    assert model.best_tags(rows).tolist() == want[::-1]


def test_field_learns_likely_tags():
    """A hidden chain: what follows `key` is a secret of one to three tokens."""
    rng = random.Random(0)
    windows = []
    for _ in range(200):
        tokens, tags = [], []
        while len(tokens) < WINDOW - 4:
            if rng.random() < 0.1:
                n = rng.randrange(1, 4)
                tokens += ["key", *["x9" * rng.randrange(3, 6) for _ in range(n)]]
                tags += [OUTSIDE, BEGIN, *[INSIDE] * (n - 1)]
            else:
                tokens.append(rng.choice(["word", "and", "Some", "12"]))
                tags.append(OUTSIDE)
        windows.append((tokens, 0, tags, ["text 1"]))
    model = fit_field(windows)
    assert model_spans(["and key x9x9x9 x9x9x9x9 word", "and word 12 Some"], model) == [[(8, 23)], []]


def test_query(spark):
    """Every row, base columns by plain expressions, and spans that hold the base ones."""
    import __spark_entry__ as driver

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in driver.queries()["op11_secrets"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want, g = plain_base(r.text), got[r.doc_id]
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [x for x in g.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("model:")] == want
        places = [tuple(map(int, x.split(":")[1:])) for x in spans]
        assert all(0 <= a < z <= len(r.text) for a, z in places) and [a for a, _ in places] == sorted(a for a, _ in places)


def test_planted_secrets_and_clean_texts(spark):
    """Secrets under names that no pattern has, in mixed case, are found; prose, numbers and code without secrets are not."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = train_field(docs)
    rng = random.Random(5)
    values = ["".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40)) for _ in range(40)]
    texts = [f'Of the oned hath er credential = "{v}" and there in the oned.' for v in values]
    found = model_spans(texts, model)
    assert sum(any(t[a:z] == v for a, z in f) for t, v, f in zip(texts, values, found)) >= 36
    clean = ["The town had 12 000 people in 1999 and 2669109448945250 ants.", 'for x in range(10): print("hello world", x)', "See https://example.com/a/b?c=1 for more.", "name = \"value\"", "", "...", "word " * 3000]
    assert model_spans(clean, model) == [[]] * len(clean)
    rows = [(1, None), (2, ""), (None, texts[0]), (3, texts[0]), (3, texts[0]), (4, "x" * 3_000_000 + " token=abcdefgh"), (5, "0f" * 600_000)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("SPANS", F.lit(1)), model).collect()
    assert len(got) == 7 and {r.spans for r in got if r.doc_id in (1, 2)} == {""} and {r.base_sha256 for r in got if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert [r.spans for r in got if r.doc_id == 3] == [r.spans for r in got if r.doc_id is None] * 2
    assert [r.spans for r in got if r.doc_id == 4] == ["assign:3000001:3000015"] and [r.spans for r in got if r.doc_id == 5] == ["hex:0:1200000"]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "only words")], "doc_id long, text string")
    assert train_field(none) is None and [r.spans for r in scan_secrets(none, None).collect()] == [""]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert train_field(empty) is None and scan_secrets(empty, None).collect() == []
