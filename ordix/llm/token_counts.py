"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are slices of equal bytes. Texts are split at boundaries that no
vocabulary piece crosses (a space after a character that isn't one), so a long
text costs no more a byte than a short one, and the lengths of the parts add up
to the length of the whole. Parts that come again are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import prepare

#: Bytes of text in a batch.
BATCH_BYTES = 1 << 20
#: Parts whose lengths a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Longer parts aren't remembered.
LONGEST = 64

_SAFE = re.compile(r"(?<=[^ ]) ")


class _Lengths:
    """Lengths by a sentencepiece model; `safe` when texts may be split at spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # Spaces must come through as they are, and no piece may reach over the start of a word.
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a  　ﬁ ", out_type=str)[0] == "▁a" and "".join(self.model.encode("a  　é ", out_type=str)).startswith("▁a▁▁")
        self.seen: dict[str, int] = {}

    def encode(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(parts, num_threads=1)]

    def learn(self, parts: set[str]) -> dict[str, int]:
        """Lengths of at least these parts."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = [p for p in parts if p not in self.seen]
        long = {p: n for p, n in zip(new, self.encode(new), strict=True)}
        if "" in long:
            long[""] = 1  # a space at the end of a text, or before another one
        self.seen.update((p, n) for p, n in long.items() if len(p) <= LONGEST)
        return self.seen | long if any(len(p) > LONGEST for p in long) else self.seen

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.encode(texts)
        texts = [t.replace("▁", " ") if "▁" in t else t for t in texts]  # the model takes both for a space
        split = [t.split(" ") if "  " not in t and t[:1] != " " else _SAFE.split(t) for t in texts]
        known = self.learn({p for s in split for p in s})
        return [sum(map(known.__getitem__, s)) if t else 0 for t, s in zip(texts, split, strict=True)]


@cache
def _lengths(path: str) -> _Lengths:
    return _Lengths(path)


def counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_bytes, n_tokens and whether they exceed the limit.

    model: path of a sentencepiece model that every executor has. No begin, end
    or added special tokens, no truncation. A null or empty text has 0 tokens;
    repeated rows each get a row; other columns aren't read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lengths(model)
        for part, t in B.slices(batches, "text", BATCH_BYTES):
            n = np.array(own.count([x or "" for x in part.column(1).to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(t.off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
