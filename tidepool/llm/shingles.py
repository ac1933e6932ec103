"""Word shingles of whole texts as 64-bit hashes, a batch of documents at a time.

Words are the maximal runs of characters other than space and U+0009..U+000D,
with A-Z lower-cased.  A document's set holds the hashes of its distinct
five-word shingles; a document of one to four words has the hash of its whole
word sequence as its only member, and a document without words (or a null
text) has the empty set.

Everything is numpy over one byte buffer per slice of a batch: a rolling
polynomial hash gives every word's hash by two look-ups in a running sum, and
a second polynomial over word hashes gives the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
SLICE_BYTES = 1_000_000

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_P_INV = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes() -> np.ndarray:
    code = mix(np.arange(1, 257, dtype=_U) * _P)
    code[ord("A") : ord("Z") + 1] = code[ord("a") : ord("z") + 1]
    return code


_CODE = _byte_codes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES + 1, n)
    if not _powers or next(iter(_powers)) < size:
        _powers.clear()
        out = []
        for base in (_P, _P_INV):
            a = np.full(size, base, dtype=_U)
            a[0] = 1
            out.append(np.cumprod(a))
        _powers[size] = (out[0], out[1])
    return next(iter(_powers.values()))


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if data.size == 0:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a separator
    power, inverse = _power_table(data.size)
    run = np.cumsum(_CODE[data] * power[: data.size])
    before = np.where(starts > 0, run[np.maximum(starts, 1) - 1], _U(0))
    hashes = mix((run[ends - 1] - before) * inverse[starts] + (ends - starts).astype(_U))
    bounds = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], bounds))))
    return hashes, counts


def _joined(w: np.ndarray, width: int) -> np.ndarray:
    total = w[: w.size - width + 1].copy()
    for k in range(1, width):
        total = total * _Q + w[k : w.size - width + 1 + k]
    return mix(total + _U(width))


def shingles(texts: Sequence[bytes | str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < SLICE_BYTES):
            t = texts[at]
            part.append(b"" if t is None else t.encode() if isinstance(t, str) else t)
            size += len(part[-1]) + 1
            at += 1
        hashes, counts = words(part)
        ends = np.cumsum(counts)
        windows = _joined(hashes, width) if hashes.size >= width else np.zeros(0, _U)
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= width:
                got = np.sort(windows[end - n : end - width + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))]
            elif n:
                yield _joined(hashes[end - n : end], n)
            else:
                yield np.zeros(0, _U)
