"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Byte n-grams of every whole text are hashed into a fixed number of buckets.
Two multinomials over the buckets are counted, one over all documents and one
over the trusted labelled documents. A document's score is the mean over its
n-grams of log p_target - log p_raw; documents below a threshold go. The ratios
are held as fixed-point integers, so a score doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import Kept, prepare, summed
from .candidates import lets_by, name_filter, names

#: Buckets of the hashed n-grams: 2 ** BITS.
BITS = 16
#: Bytes in an n-gram.
N = 4
#: Documents whose mean log ratio is lower go.
THRESHOLD = -0.25
#: Fixed-point scale of the log ratios.
SCALE = 1 << 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _buckets(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and the offsets by text of those inside a text."""
    n = max(0, len(t.data) - N + 1)
    key = np.zeros(n, np.uint32)
    for j in range(N):
        key = (key << np.uint32(8)) | t.data[j : j + n]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return key, np.maximum(np.diff(t.off) - N + 1, 0)


def _counts(t: B.Texts, keep: np.ndarray | None = None) -> np.ndarray:
    key, n = _buckets(t)
    if keep is not None:
        n = np.where(keep, n, 0)
    at = B.ranges(t.off[:-1], n)
    return np.bincount(key[at], minlength=1 << BITS)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw by bucket, in fixed point; add-one smoothing.

    trusted: one column of ids, of any type that has a string form, and of any
    number; all of them are the target. With no trusted text the ratio is 0
    everywhere. Null ids are never trusted; repeated rows each count.

    One pass counts all documents. Those that a filter of fixed size lets by are
    joined with the ids, by shuffles, and counted again as far as they are trusted.
    """
    prepare(docs.sparkSession)
    # Written, as Spark splits an id of very many rows between plain exchanges only.
    known = Kept(trusted.select(F.col(trusted.columns[0]).cast("string").alias("known")).where("known IS NOT NULL").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(name_filter(known.df.select(F.unhex(F.md5("known")))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for part, t in B.slices(batches, "text"):
            total += _counts(t)
            has = np.flatnonzero(part.column(0).is_valid())
            at = pa.array(has[lets_by(bits.value, names(part.column(1).drop_null()))])
            if len(at):
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at).cast(pa.string()), pa.nulls(len(at), pa.binary())], ["id", "text", "v"])
        # A name of its own, as rows without one would all meet in one task.
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.nulls(1, pa.string()), pa.array([total.tobytes()], pa.binary())], ["id", "text", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, np.int64)
        for part, t in B.slices(batches, "text"):
            for v in part.column(2).drop_null():
                total[: 1 << BITS] += np.frombuffer(v.as_buffer(), np.int64)
            own = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            if own.any():
                total[1 << BITS :] += _counts(t, own)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    own = F.col(id_col).cast("string")
    rows = docs.select(own.alias("id"), F.unhex(F.md5(own)).alias("name"), F.col(text_col).alias("text")).mapInArrow(count, "id string, text string, v binary")
    joined = rows.join(known.df.hint("merge"), F.col("id") == F.col("known"), "left")
    total = summed(joined.select(F.when(F.col("v").isNull(), F.col("known")).alias("known"), "text", "v").mapInArrow(add, "v binary"), 2 << BITS)
    bits.destroy()
    known.drop()
    raw, target = total[: 1 << BITS] + 1.0, total[1 << BITS :] + 1.0
    if not (target > 1).any():
        return np.zeros(1 << BITS, np.int64)
    return np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * SCALE).astype(np.int64)


def measures(t: B.Texts, ratio: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """What the rules see of each text, and their verdict."""
    ws, we, woff = B.words(t, B.SPACED)
    n_words = np.diff(woff)
    prefix = t.prefix()
    inside = B.SPACED[t.data] & ((t.data & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": B.sums(inside, t.off), "n_symbols": B.sums(_SYMBOL[t.data], t.off)}

    # Lines with a word that equal an earlier line of the same text.
    ls, le, loff = B.runs(t.data != 10, t.off)
    has = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    doc = B.ids(np.diff(loff))[has]
    out["n_dup_lines"] = np.bincount(doc[_again(doc, B.span_hash(prefix, ls[has], le[has]))], minlength=t.n)

    # Words inside a 3-word window that the text has twice or more.
    h = B.span_hash(prefix, ws, we)
    g = B.grams(h, 3)
    at = B.ranges(woff[:-1], np.maximum(n_words - 2, 0))
    doc = np.repeat(np.arange(t.n), np.maximum(n_words - 2, 0))
    twice = at[_shared(doc, g[at])]
    hit = np.zeros(len(h), bool)
    for j in range(3):
        hit[twice + j] = True
    out["n_repeat_words"] = B.sums(hit, woff)

    key, n = _buckets(t)
    total = np.zeros(len(key) + 1, np.int64)
    np.cumsum(ratio[key], out=total[1:])
    start = np.minimum(t.off[:-1], len(key))
    score = (total[start + n] - total[start]) / np.maximum(n, 1) / SCALE
    out["score"] = score
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["kept"] = ~out["base_failed"] & (score >= threshold)
    return out


def _order(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (doc, key), and which item of it equals the one before."""
    k = B.mix(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(k, kind="stable")
    same = np.zeros(len(k), bool)
    same[1:] = (k[order][1:] == k[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, same


def _again(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    order, same = _order(doc, key)
    return order[same]


def _shared(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    order, same = _order(doc, key)
    both = same.copy()
    both[:-1] |= same[1:]
    return order[both]


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id, the measures and the verdict.

    A null or empty text has no words and fails the base rules; repeated rows
    each get a row; other columns aren't read, so their names can't clash. A text
    is whole in memory, with some 60 bytes for each of its own.
    """
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in _MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.slices(batches, "text"):
            m = measures(t, ratio, threshold)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[x].astype(np.int64) if x[:2] in ("n_", "wo") else m[x]) for x in names)], ["doc_id", *names])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {_MEASURES}")


def keep(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.slices(batches, text_col):
            yield part.filter(pa.array(measures(t, ratio, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def trusted_ids(labels: DataFrame, good: Column | None = None) -> DataFrame:
    """Ids of labelled rows that are good; by default of quality 1."""
    return labels.where(F.col("quality") == 1 if good is None else good).select("doc_id")
