"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three code points, A-Z and other
capitals lower-cased) with sublinear TF-IDF weights, unit length.  Document
frequencies are counted over all training rows.  Weights are learned by
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, on
shards of a bounded sample (`fit_rows`) in parallel; the shards' states are
averaged and the penalty's threshold applied to the average, so that weights
stay sparse.  A part of the sample that no shard sees sets the temperature that
calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import keep_rows
from tidepool.llm.shared import Scratch

BITS = 14
SIZE = 1 << BITS
UNKNOWN = "und"
_SEGMENT = 1 << 20
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_DOWN = np.uint32(32 - BITS)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in a text, a segment at a time."""
    total = np.zeros(SIZE, dtype=np.int64)
    text = text.lower()
    for a in range(0, len(text), _SEGMENT):
        # segments overlap by two characters, which start no n-gram of their own there
        c = np.frombuffer(text[a : a + _SEGMENT + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        one = (c + np.uint32(1)) * _A
        two = (one[:-1] ^ (one[1:] >> np.uint32(15))) * _B + one[1:]
        three = (two[:-1] ^ (one[2:] >> np.uint32(13))) * _C + one[2:]
        for h in (one[:_SEGMENT] * _C, two[:_SEGMENT] * _A, three[:_SEGMENT] * _B):
            total += np.bincount(h >> _DOWN, minlength=SIZE)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(ngram_counts(text), self.idf)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return x @ self.weights[at] + self.weights[SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm > 0 else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over classes; the last row of weights is the bias."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((SIZE + 1, classes))
        self.n = np.zeros((SIZE + 1, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / step, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, SIZE), np.append(x, 1.0)
        w = self.weights(at)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE, dtype=np.int64)
    for b in batches:
        for t in b["text"].to_pylist():
            total += ngram_counts(t) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "df"])


def fit_language_model(rows: DataFrame, fit_rows: int = 8000, shards: int = 8, epochs: int = 3) -> LanguageModel:
    """A model from `rows` (doc_id, text, lang), none null; the sample goes by a hash of doc_id."""
    spark = rows.sparkSession
    frequencies = rows.select("text").mapInArrow(_document_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, many = sorted(by_lang), sum(by_lang.values())
    df = np.zeros(SIZE)
    df[frequencies["feature"].to_numpy()] = frequencies["df"].to_numpy()
    idf = np.log((1 + many) / (1 + df)) + 1
    share = min(1.0, fit_rows / max(1, many))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    sample = rows.where(draw < int(share * 1_000_000)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    scratch = Scratch(spark, "language")
    sample = scratch.save(sample.select("doc_id", "text", "lang", "fold"), "sample")
    known = spark.sparkContext.broadcast((langs, idf))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf = known.value
        code = {x: k for k, x in enumerate(langs)}
        seen = [(*tf_idf(ngram_counts(t), idf), code[x]) for b in batches for t, x in zip(b["text"].to_pylist(), b["lang"].to_pylist())]
        if seen:
            model = Ftrl(len(langs))
            for _ in range(epochs):
                for at, x, y in seen:
                    model.learn(at, x, y)
            states = [pa.array([x.tobytes()], pa.binary()) for x in (model.z, model.n)]
            yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64()), *states], ["rows", "z", "n"])

    learned = (
        sample.where("fold <> 0").repartition(shards, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards))).sortWithinPartitions("doc_id", "text")
        .select("text", "lang").mapInArrow(learn, "rows long, z binary, n binary").collect()
    )
    mean = Ftrl(len(langs))
    for r in learned:
        part = r["rows"] / sum(x["rows"] for x in learned)
        mean.z += np.frombuffer(bytes(r["z"])).reshape(mean.z.shape) * part
        mean.n += np.frombuffer(bytes(r["n"])).reshape(mean.n.shape) * part
    model = LanguageModel(langs, idf, mean.weights())
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = [m.logits(t).tolist() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["lang"], pa.array(z, pa.list_(pa.float64()))], ["lang", "z"])

    held = sample.where("fold = 0").select("text", "lang").mapInArrow(score, "lang string, z array<double>").collect()
    if held:
        z, y = np.array([r["z"] for r in held]), np.array([langs.index(r["lang"]) for r in held])
        tries = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tries]
        model.temperature = float(tries[int(np.argmin(loss))])
    scratch.drop("sample")
    return model


def predict_language(docs: DataFrame, model: LanguageModel, extra: list[Column] | None = None) -> DataFrame:
    """(doc_id, *extra, lang_pred, score) for every row of `docs` (doc_id, text).

    `lang_pred` is `und` and the score 0 for texts that are null or have no
    letter, or if the model knows no language.  Repeated rows stay; a null
    doc_id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b["text"].to_pylist()]
            found, scores = [x[0] for x in got], [x[1] for x in got]
            yield pa.RecordBatch.from_arrays(
                [*(b[n] for n in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(extra or []))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 by 4; rows without a doc_id are held out, too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang) that may be learned from: not held out, with a lang and a letter."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")


def identify_languages(docs: DataFrame, fit_rows: int = 8000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang).

    Rows with a null lang or text teach nothing; a null text is `und`.
    Repeated rows stay; a null doc_id stays null and is held out; an empty
    table gives no rows; other columns are ignored.
    """
    model = fit_language_model(training_rows(docs), fit_rows)
    return predict_language(docs, model, [held_out(F.col("doc_id")).alias("held_out")])


def drop_unidentified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of `docs` (with a column text) in a known language with a score of `least`, with all their columns.

    Null texts and texts without a letter are in no language and go.  Repeated
    rows stay; an empty table gives no rows; other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def test() -> Callable[[list], list[bool]]:
        m = shared.value
        return lambda texts: [lang != UNKNOWN and score >= least for lang, score in map(m.predict, texts)]

    return keep_rows(docs, "text", test)
