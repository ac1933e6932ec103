"""Secrets in texts: fixed patterns, and what a linear-chain conditional random field finds besides.

Tokens are runs of ASCII letters and digits, or single other characters.  Each
is tagged as begin, inside or outside of a secret from its own shape, the words
before and after it and features of the whole text; the best tags of a whole
text are found by Viterbi's algorithm.  The field is trained on windows around
the patterns' own finds and elsewhere, a bounded sample.  Scores hang on token
types, so that a batch's scores are table look-ups; tokens whose tag is certain
whatever their neighbours' tags cut the text into the short runs that Viterbi's
algorithm has to decide.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.arrow import slices
from tidepool.llm.shared import Scratch

#: Names of assigned secrets, and the patterns of the contract.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Tokens of a training window, and of them those before the secret.
WINDOW, BEFORE = 24, 12
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_PAD = "\n"  # no token is white space
_ROLES = (-3, -2, -1, 0, 1)
_CLASSES = str.maketrans({**{c: "A" for c in map(chr, range(65, 91))}, **{c: "a" for c in map(chr, range(97, 123))}, **{c: "0" for c in "0123456789"}})
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)
_HELD_TYPES = 400_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order; kinds are numbers of `KINDS`."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # a run of the class that is long enough is found from its first character or not at all
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def secret_values(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of spans that are secret: an assignment's value, else the whole."""
    return sorted({_ASSIGN.match(text, a).span(2) if k == 0 else (a, z) for a, k, z in spans})


def own_features(token: str) -> list[str]:
    """Of a token's shape: letter classes, length, share of digits, hexadecimal or not, variety of characters."""
    classes = token.translate(_CLASSES)
    shape, size = _AGAIN.sub(r"\1", classes)[:12], min(len(token), 48) // 4
    digits = classes.count("0")
    out = [f"shape {shape}", f"size {size}", f"shape {shape[:4]} {size}", f"digits {8 * digits // len(token)} {min(size, 4)}"]
    if digits and not set(token) - set("0123456789abcdefABCDEF"):
        out.append(f"hex {min(size, 6)}")
    if len(token) >= 8:
        out.append(f"variety {4 * len(set(token[:256])) // min(len(token), 256)}")
        out.append(f"turns {min(len(_AGAIN.sub(r'\1', classes[:256])) * 4 // min(len(token), 256), 4)}")
    return out


def neighbour_features(token: str) -> list[str]:
    """Of a token as another's neighbour: the word, and whether it is a word, a number or a sign."""
    return [token[:20].lower(), "number" if token.isdigit() else "word" if token.isalnum() else "sign"]


def text_features(text: str) -> list[str]:
    """Of the whole text: its length, and how many signs of code it has by length."""
    size = max(1, len(text))
    return [f"text {min(10, int(math.log2(size)) // 2)}", *(f"text {c}{min(4, int(400 * text.count(c) / size))}" for c in "={;")]


@dataclass
class Field:
    """Weights of features by role and tag, and of neighbouring tags; texts begin and end outside."""

    weights: dict[tuple[int, str], np.ndarray]
    moves: np.ndarray
    types: dict[str, int] = field(default_factory=dict)
    tables: list[np.ndarray] = field(default_factory=list)

    def certain(self) -> float:
        """By how much outside has to lead so that no neighbours' tags make another one better."""
        t = self.moves
        return float(max(t[p, y] + t[y, q] - t[p, OUTSIDE] - t[OUTSIDE, q] for p in range(3) for q in range(3) for y in (BEGIN, INSIDE)))

    def _sum(self, role: int, names: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for n in names:
            w = self.weights.get((role, n))
            if w is not None:
                out += w
        return out

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Scores of tags for tokens in a row, without those of whole texts."""
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        if len(self.types) > _HELD_TYPES or not self.tables:
            self.types, self.tables = {}, [np.zeros((0, 3)) for _ in _ROLES]
        names = coded.dictionary.to_pylist()
        fresh = [n for n in names if n not in self.types]
        if fresh:
            near = [neighbour_features(n) for n in fresh]
            for k, role in enumerate(_ROLES):
                rows = [self._sum(role, f if role else own_features(n)) for n, f in zip(fresh, near)]
                self.tables[k] = np.concatenate([self.tables[k], np.array(rows)])
            self.types.update(zip(fresh, range(len(self.types), len(self.types) + len(fresh))))
        code = np.fromiter((self.types[n] for n in names), np.int64, len(names))[coded.indices.to_numpy()]
        out = self.tables[_ROLES.index(0)][code]
        for k, role in enumerate(_ROLES):
            if role < 0:
                out[-role:] += self.tables[k][code[:role]]
            elif role > 0:
                out[:-role] += self.tables[k][code[role:]]
        return out

    def text_scores(self, text: str) -> np.ndarray:
        return self._sum(0, text_features(text))

    def best_tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of a row of scores whose first and last stand outside."""
        tags = np.full(len(scores), OUTSIDE, np.int8)
        open_ = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= self.certain()
        edge = np.diff(np.r_[0, open_.astype(np.int8), 0])
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are the first ones
        starts, sizes = starts[order], (ends - starts)[order]
        if not starts.size:
            return tags
        back = []
        best = scores[starts] + self.moves[OUTSIDE]
        running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for t in range(1, sizes[0]):
            n = running[t]
            paths = best[:n, :, None] + self.moves[None]
            back.append(paths.argmax(axis=1))
            best[:n] = paths.max(axis=1) + scores[starts[:n] + t]
        tag = (best + self.moves[:, OUTSIDE]).argmax(axis=1)
        for t in range(sizes[0] - 1, -1, -1):
            n = running[t]
            tags[starts[:n] + t] = tag[:n]
            if t:
                # a run that ends here stays at its last tag until its turn comes
                tag[:n] = back[t - 1][np.arange(n), tag[:n]]
        return tags


def _windows(modulus: int):
    """(secret, tokens, tags, text features) of windows at the patterns' finds, and of one window elsewhere in some texts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows = []
            for text in b["text"].to_pylist():
                crc = zlib.crc32(text.encode())
                values = secret_values(text, base_spans(text))
                if not values and crc % modulus:
                    continue
                found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
                tags, k, last = [OUTSIDE] * len(found), 0, -1
                firsts = []
                for n, (_, a, z) in enumerate(found):
                    while k < len(values) and values[k][1] <= a:
                        k += 1
                    if k < len(values) and values[k][0] < z:
                        tags[n] = INSIDE if last == k else BEGIN
                        firsts += [n] * (last != k)
                        last = k
                features = text_features(text)
                at = [*firsts[:2], *([crc % max(1, len(found))] if crc % modulus == 0 and found else [])]
                for n in at:
                    a = max(0, n - BEFORE)
                    own = tags[a : a + WINDOW]
                    rows.append({"secret": any(t != OUTSIDE for t in own), "tokens": [x for x, _, _ in found[max(0, a - 3) : a + WINDOW + 1]], "skip": min(a, 3), "tags": own, "features": features})
            yield pa.RecordBatch.from_pylist(rows, _WINDOWS)

    return windows


_WINDOWS = pa.schema([("secret", pa.bool_()), ("tokens", pa.list_(pa.string())), ("skip", pa.int32()), ("tags", pa.list_(pa.int32())), ("features", pa.list_(pa.string()))])


def fit_field(windows: list[tuple[list[str], int, list[int], list[str]]], steps: int = 120, rate: float = 0.3, penalty: float = 0.02) -> Field:
    """A field of the highest likelihood of windows (tokens with context, tokens before the window, tags, text features), less a squared penalty."""
    index: dict[tuple[int, str], int] = {}
    rows, tags = [], np.full((len(windows), WINDOW), OUTSIDE)
    for w, (tokens, skip, own, features) in enumerate(windows):
        tags[w, : len(own)] = own
        for t in range(WINDOW):
            at, names = t + skip, []
            if t < len(own):
                names = [(0, f) for f in (*own_features(tokens[at]), *features)]
                for role in _ROLES:
                    if role:
                        near = tokens[at + role] if 0 <= at + role < len(tokens) else _PAD
                        names += [(role, f) for f in neighbour_features(near)]
            rows.append([index.setdefault(n, len(index)) for n in names])
    many = max(map(len, rows))
    table = np.full((len(rows), many), len(index))
    for k, r in enumerate(rows):
        table[k, : len(r)] = r
    weights, moves = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    seen = np.eye(3)[tags]
    with_edges = np.pad(tags, ((0, 0), (1, 1)), constant_values=OUTSIDE)
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (with_edges[:, :-1].ravel(), with_edges[:, 1:].ravel()), 1.0)
    squares = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    for _ in range(steps):
        scores = weights[table].sum(axis=1).reshape(len(windows), WINDOW, 3)
        forward, backward = np.empty_like(scores), np.empty_like(scores)
        forward[:, 0] = scores[:, 0] + moves[OUTSIDE]
        for t in range(1, WINDOW):
            forward[:, t] = scores[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None], axis=1)
        backward[:, -1] = moves[:, OUTSIDE]
        for t in range(WINDOW - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[:, 0] + backward[:, 0], axis=1)
        single = np.exp(forward + backward - total[:, None, None])
        both = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        both[OUTSIDE] += single[:, 0].sum(axis=0)
        both[:, OUTSIDE] += single[:, -1].sum(axis=0)
        gap = ((single - seen) / len(windows)).reshape(-1, 3)
        slope = np.stack([np.bincount(table.ravel(), weights=np.repeat(gap[:, y], many), minlength=len(weights)) for y in range(3)], axis=1)
        for x, g, s in ((weights, slope + penalty / len(windows) * weights, squares[0]), (moves, (both - pairs) / len(windows), squares[1])):
            s += g * g
            x -= rate * g / np.sqrt(s)
        weights[-1] = 0
    return Field({n: weights[k] for n, k in index.items()}, moves)


def train_field(docs: DataFrame, fit_windows: int = 1500, scratch: Scratch | None = None) -> Field | None:
    """A field from at most `fit_windows` windows with secrets, by the patterns, and as many without; none if the patterns find nothing."""
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    texts = docs.where("text is not null and text <> ''").select("text")
    modulus = max(1, texts.count() // (4 * fit_windows))
    rows = texts.mapInArrow(_windows(modulus), "secret boolean, tokens array<string>, skip int, tags array<int>, features array<string>")
    rows = scratch.save(rows.withColumn("turn", F.xxhash64("tokens", "skip")), "windows")
    drawn = [r for side in (True, False) for r in rows.where(F.col("secret") == side).orderBy("turn", "tokens", "features").limit(fit_windows).collect()]
    scratch.drop("windows")
    if not any(r["secret"] for r in drawn):
        return None
    return fit_field([(r["tokens"], r["skip"], r["tags"], r["features"]) for r in drawn])


def model_spans(texts: list[str], model: Field) -> list[list[tuple[int, int]]]:
    """(start, end) of what the field tags as secret in each text."""
    tokens, cuts = [_PAD] * 3, []
    bias = [np.zeros((1, 3))]
    for t in texts:
        own = _TOKEN.findall(t)
        cuts.append((len(tokens), len(tokens) + len(own)))
        tokens += own
        tokens += [_PAD] * 3
        bias.append(model.text_scores(t)[None])
    scores = model.scores(tokens)
    spans = []
    for k, (a, z) in enumerate(cuts):
        scores[a:z] += bias[k + 1]
    pads = np.ones(len(tokens), bool)
    for a, z in cuts:
        pads[a:z] = False
    scores[pads] = (-1e9, -1e9, 0.0)
    tags = model.best_tags(scores)
    for t, (a, z) in zip(texts, cuts):
        own = tags[a:z]
        if (own == OUTSIDE).all():
            spans.append([])
            continue
        out: list[list[int]] = []
        for n, m in enumerate(_TOKEN.finditer(t)):
            if own[n] == BEGIN or (own[n] == INSIDE and (n == 0 or own[n - 1] == OUTSIDE)):
                out.append([m.start(), m.end()])
            elif own[n] == INSIDE:
                out[-1][1] = m.end()
        spans.append([(x, y) for x, y in out])
    return spans


def scan_secrets(docs: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of `docs` (doc_id, text).

    The patterns' spans always stay; spans that the field tags and that share
    no character with one of them come besides, as `model`.  Offsets are code
    points, ends exclusive; `spans` is `kind:start:end` by start and kind,
    joined by commas, and `base_sha256` the digest of the patterns' part of it.
    Null texts count as empty, which have no spans.  Texts are scanned whole.
    Repeated rows stay; a null doc_id stays null; an empty table gives no
    rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, 100):
            texts = [t or "" for t in b["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [list(s) for s in base]
            if own is not None:
                for spans, more in zip(every, model_spans(texts, own)):
                    patterns = list(spans)
                    spans += [(a, 3, z) for a, z in more if not any(x < z and a < y for x, _, y in patterns)]
                    spans.sort()
            columns = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in (0, 1, 2)]
            digests = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns, pa.array(digests), pa.array(map(_joined, every), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
