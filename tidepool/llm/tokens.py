"""Token counts of whole texts, with huge ones spliced from overlapping chunks.

A text of up to `chunk` characters is encoded as it is.  A longer one is
encoded in chunks that overlap, with offsets, and the token runs are spliced at
a boundary in the overlap that is proven stable: the two characters around it
stand next to each other in no piece of the vocabulary.  Byte-pair merges only
ever build pieces of the vocabulary, so none crosses such a boundary and what
lies on one side of it can't change the tokens on the other.  Both runs must
also show a token boundary there.  Where an overlap has none, it is widened,
in the end to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
_loaded: dict[int, SplicingTokenizer] = {}


class SplicingTokenizer:
    def __init__(self, model: bytes, chunk: int, overlap: int) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)))
        self.joined = {pair for p in pieces for pair in zip(p, p[1:])}

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can hold the characters on both sides of `at`."""
        a, b = (_SPACE if c == " " else c for c in text[at - 1 : at + 1])
        return (a, b) not in self.joined

    def _starts(self, text: str) -> np.ndarray:
        """The byte offsets at which tokens start."""
        return np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], dtype=np.int64)

    def spliced_count(self, text: str) -> int:
        total, start, end = 0, 0, self.chunk
        while True:
            end = min(end, len(text))
            begin = max(0, start - self.overlap)
            starts = self._starts(text[begin:end])
            skip = len(text[begin:start].encode())
            if start and skip not in starts:  # the runs do not meet here: widen to the left
                if not begin:
                    return len(self.model.encode(text))
                starts = self._starts(text[:end])
                skip = len(text[:start].encode())
                begin = 0
                if skip not in starts:
                    return len(self.model.encode(text))
            if end == len(text):
                return total + int(np.count_nonzero(starts >= skip))
            known = set(starts.tolist())
            for cut in range(end - 1, max(start, end - self.overlap), -1):
                if self.stable(text, cut) and len(text[begin:cut].encode()) in known:
                    break
            else:
                end += self.chunk  # no stable boundary: widen to the right
                continue
            edge = len(text[begin:cut].encode())
            total += int(np.count_nonzero((starts >= skip) & (starts < edge)))
            start, end = cut, cut + self.chunk

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk else "" for t in texts]
        found = [len(x) for x in self.model.encode(short, num_threads=1)] if texts else []
        return [n if len(t) <= self.chunk else self.spliced_count(t) for n, t in zip(found, texts)]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 30_000, overlap: int = 500) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text).

    A null text counts as empty: 0 bytes and 0 tokens.  Counts are those of the
    model's library for the whole text.  Repeated rows stay; a null doc_id
    stays null; an empty table gives no rows.  The model file is read by the
    driver and sent to the executors.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((model.value, chunk, overlap))
        if key not in _loaded:
            _loaded[key] = SplicingTokenizer(model.value, chunk, overlap)
        tokenizer = _loaded[key]
        for b in batches:
            got = [n for a in range(0, b.num_rows, 64) for n in tokenizer.counts([t or "" for t in b["text"].slice(a, 64).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(got, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
