"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, replaces look-alike letters of other
scripts and digits or signs that stand for letters in words, and makes
everything else a space.  The lexicon's terms are whole words, and beginnings
of words of 4 to 12 letters; their weights are lower bounds of the log-odds of
toxic documents, learned from labelled rows by counting different texts.  Texts
are always matched as a whole.  One pass of the automaton finds terms and
exception phrases; a term within an exception phrase does not count.  The
weights found, normalised by length, give a calibrated score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import keep_rows
from tidepool.llm.shared import Scratch

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авеѕіјкмнорстухԁԛԝɡαβεικνορτυχϲ", "abesijkmhopctyxdqwgabeikvoptuxc", strict=True))
#: Digits and signs that stand for letters.
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which a term is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "idiot proof", "loser bracket", "pond scum", "clown school")

#: Standard errors by which a term's log-odds are lowered (a bound that holds 19 times in 20), so that rare words of a few documents weigh little.
DOUBT = 1.64
#: Letters of a word's beginnings that may be terms.
SHORTEST, LONGEST = 4, 12
_LETTERS = DIGITS | str.maketrans(SIGNS)
_NO_SIGNS = str.maketrans(dict.fromkeys(SIGNS, " "))
#: A run of letters, digits and signs that holds a digit or sign; possessive, so that long runs are read once.
_MIXED = re.compile(r"(?<!\S)[^\s\d@$!|]*+[\d@$!|]\S*+")


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = HOMOGLYPHS.get(c, c)
        if c in SIGNS:
            self[code] = c
            return c
        c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        c = "".join(HOMOGLYPHS.get(x, x) if x.isalnum() else "" for x in c) or ("" if unicodedata.combining(chr(code)) else " ")
        self[code] = c
        return c


_FOLDING = _Folding()


def _letters(m: re.Match) -> str:
    """Digits and signs of a run as letters, if it holds a letter; `!` and `|` at its end are punctuation."""
    run = m[0]
    if not any(c.isalpha() for c in run):
        return run.translate(_NO_SIGNS)
    word = run.rstrip("!|")
    return word.translate(_LETTERS) + " " * (len(run) - len(word))


def fold(text: str | None) -> str:
    """Words of folded letters, each with a space before and after."""
    if not text:
        return " "
    return f" {_MIXED.sub(_letters, text.translate(_FOLDING))} "


def terms_of(folded: str) -> set[str]:
    """Whole words (` word `) and beginnings of words (` wor`) as the automaton sees them."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float) -> dict[str, float]:
    """Terms with log-odds of `least` or more, less DOUBT standard errors; of terms that begin alike, the shortest that is as telling."""
    weighed = {
        t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) - DOUBT * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) for t, a, b in counts
    }
    kept: dict[str, float] = {}
    for t in sorted(weighed, key=lambda t: (len(t.rstrip()), t)):
        w = weighed[t]
        if w < least:
            continue
        begun = max((kept[t[:n]] for n in range(SHORTEST + 1, len(t)) if t[:n] in kept), default=None)
        if begun is None or w > begun + 1.0:
            kept[t] = w
    return kept


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0]))

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            key = f" {fold(p).strip()} "
            if key.strip() and key not in a:
                a.add_word(key, (len(key), 0.0))
        a.make_automaton()
        return a


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Weight found, and weight found per square root of the number of words, both on a log scale."""
    if not len(automaton):
        return 0.0, 0.0
    hits: dict[int, float] = {}
    spared: list[list[int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w:
            hits[start] = max(w, hits.get(start, 0.0))
        else:
            # ends only grow, so spans that this one meets are the last ones
            while spared and spared[-1][1] >= start:
                start = min(start, spared.pop()[0])
            spared.append([start, end])
    if spared:
        starts = [a for a, _ in spared]
        hits = {s: w for s, w in hits.items() if not (k := bisect_right(starts, s)) or s >= spared[k - 1][1]}
    total = sum(hits.values())
    words = folded.count(" ")
    return math.log1p(total), math.log1p(10 * total / math.sqrt(words + 20))


def _probability(found: tuple[float, float], c: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * found[0] + c[2] * found[1]))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term and label, added up within the task and given out when there are many."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"]
        )
        seen[0].clear()
        seen[1].clear()
        return out

    for b in batches:
        for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            seen[y].update(terms_of(fold(text)))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield rows()
    yield rows()


def fit_lexicon(sample: DataFrame, least_documents: int = 5, least_log_odds: float = 1.5) -> Lexicon:
    """A lexicon from a bounded sample (doc_id, text, toxic 0 or 1), none null.

    Three quarters, by a hash of doc_id, are for the terms and the rest to
    calibrate the score.  All terms that are telling enough are taken; the
    sample bounds how many there can be.
    """
    spark = sample.sparkSession
    held = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(4)) == 0
    by_label = {r["toxic"]: r["n"] for r in sample.where(~held).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = by_label.get(1, 0), by_label.get(0, 0)
    counted = (
        sample.where(~held).select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least_documents) & (F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)) >= least_log_odds))
        .collect()
    )
    lexicon = Lexicon(choose_terms([(r["term"], r["toxic"], r["clean"]) for r in counted], toxic, clean, least_log_odds))
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value.automaton()
        for b in batches:
            f = [features(fold(t), a) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array([v[0] for v in f], pa.float64()), pa.array([v[1] for v in f], pa.float64())], ["toxic", "a", "b"])

    got = sample.where(held).select("text", "toxic").mapInArrow(measured, "toxic int, a double, b double").collect()
    if got:
        x = np.array([(1.0, r["a"], r["b"]) for r in got])
        lexicon.coefficients = _logistic(x, np.array([float(r["toxic"]) for r in got]))
        lexicon.coefficients[1:] = np.maximum(lexicon.coefficients[1:], 0)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, extra: list[Column] | None = None) -> DataFrame:
    """(doc_id, *extra, score, predicted) for every row of `docs` (doc_id, text).

    Null and empty texts have the score of a text without any term.  Repeated
    rows stay; a null doc_id stays null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = shared.value.automaton(), shared.value.coefficients
        for b in batches:
            out = [_probability(features(fold(t), a), c) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(out, pa.float64())], [*names, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(extra or []))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score double"
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` (with a column text) that score under `threshold`, with all their columns.

    Null and empty texts score as one without any term.  Repeated rows stay;
    an empty table gives no rows; other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def test() -> Callable[[list], list[bool]]:
        a, c = shared.value.automaton(), shared.value.coefficients
        return lambda texts: [_probability(features(fold(t), a), c) < threshold for t in texts]

    return keep_rows(docs, "text", test)


def labelled_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 16_000, scratch: Scratch | None = None) -> Lexicon:
    """A lexicon from documents whose doc_id is not held out: crc32 of it as text does not leave 1 by 3.

    At most about `fit_rows` labels are used, chosen by a hash of doc_id, so
    their side of the join is small enough to be broadcast.  Labels other than
    0 and 1 are ignored; of several labels of one doc_id the largest counts.
    Copies of a text with one label count once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    lexicon = fit_lexicon(scratch.save(rows, "sample"))
    scratch.drop("sample")
    return lexicon


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True)).alias("held_out")
