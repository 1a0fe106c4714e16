"""Line dedup: near-equal lines by MinHash over the whole corpus; one line of each component stays.

Lines are sets of character shingles. Equal lines are one item. Signatures are
cut into bands; items that share a band form clusters (see candidates), inside
which Jaccard similarity is verified exactly; links are joined by distributed
union-find. The earliest line of a component, by document id, text hash and line
number, stays, and all its other lines go from their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import Kept, prepare, release, unused
from .candidates import Items, binary, clusters, codes, links, short

#: Characters in a shingle; a shorter line is one shingle.
K = 8
#: Links need this Jaccard similarity, in hundredths.
PERCENT = 80
#: Bands and rows: a pair of similarity 0.8 is found with probability 1 - (1 - 0.8^6)^24 = 0.9993.
BANDS, ROWS = 24, 6
#: Bytes of text whose lines are worked on together, few enough for a core's cache.
CACHE_BYTES = 128 << 10

_rng = np.random.Generator(np.random.PCG64(77))
#: Of 32 bits: minima of shorter values would be alike in all very long lines.
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
#: A second random value for each byte, for the other half of the names.
_T2 = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that alone don't make a line.
_SOLID = B.table(lambda b: not (9 <= b <= 13 or b == 32))


class Lines:
    """The lines of a slice that hold more than white space. Offsets are in bytes, shingles in characters."""

    def __init__(self, t: B.Texts):
        self.data = data = t.data
        breaks = np.flatnonzero(data == 10)
        # All pieces between breaks and ends of texts, empty and white ones too: starts and ends come in the same order.
        start = np.sort(np.concatenate([t.off[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([breaks, t.off[1:]]), kind="stable")
        many = np.diff(np.searchsorted(breaks, t.off)) + 1
        at = np.flatnonzero(end > start)
        solid = _SOLID[data[start[at]]]
        if len(white := at[~solid]):  # at their start: these are read whole
            n = end[white] - start[white]
            solid[~solid] = np.logical_or.reduceat(_SOLID[data[B.ranges(start[white], n)]], np.cumsum(n) - n)
        held = at[solid]
        self.start, self.end, self.doc = start[held], end[held], B.ids(many)[held]
        self.number = held - (np.cumsum(many) - many)[self.doc]
        pw, self.ip = B._powers(len(data) + 1)
        long = (self.end - self.start).astype(np.uint64)

        def name(values: np.ndarray) -> np.ndarray:
            # Breaks are 0, so all that lies between the starts of two pieces is the first one's.
            own = np.add.reduceat(values, start[at])[solid] if len(at) else values[:0]
            return B.mix(own * self.ip[self.start] + long)

        self.values = self._values(B._T, pw, breaks)
        self.name = np.stack([name(self.values), name(self._values(_T2, pw, breaks))], axis=1)
        self.size = np.maximum(self.end - self.start - K + 1, 1)  # at most, in bytes

    def _values(self, table: np.ndarray, pw: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """What each byte adds to a fingerprint; breaks add nothing."""
        out = np.take(table, self.data, mode="clip")
        out *= pw[: len(out)]
        out[breaks] = 0
        return out

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the given lines, in ascending order, with repeats, and their offsets."""
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.values, out=prefix[1:])
        first = self.data.view(np.int8) >= -64  # bytes of characters
        first[self.start] = True  # whatever bytes a line is made of
        chars = np.flatnonzero(first)
        a, z, inverse = self.start[which], self.end[which], self.ip
        if len(chars) < len(self.data):
            a, z = np.searchsorted(chars, a), np.searchsorted(chars, z)
            prefix, inverse = prefix[np.append(chars, len(self.data))], inverse[chars]
        # The shingle at every character, then those that don't cross the end of a line.
        key = np.zeros(len(chars), np.uint64)
        full = max(0, len(key) - K + 1)
        np.subtract(prefix[K:], prefix[:full], out=key[:full])
        key[:full] *= inverse[:full]
        low = np.flatnonzero(z - a < K)
        key[a[low]] = (prefix[z[low]] - prefix[a[low]]) * inverse[a[low]]
        n = np.maximum(z - a - K + 1, 1)
        gaps = np.diff(np.concatenate(([0], np.stack([a, a + n], axis=1).ravel(), [len(key)])))
        own = np.repeat(np.arange(len(gaps)) % 2 == 1, gaps)
        return B.mix(key[own]), np.concatenate(([0], np.cumsum(n)))

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of the given lines and their offsets."""
        key, off = self.shingles(which)
        doc = B.ids(np.diff(off))
        order = np.argsort(key)
        # Few lines are told by 16 bits, which numpy sorts in linear time.
        order = order[np.argsort(doc[order].astype(np.uint16 if len(which) <= 1 << 16 else np.int64), kind="stable")]
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new], np.searchsorted(doc[new], np.arange(len(which) + 1))

    def bands(self, which: np.ndarray) -> np.ndarray:
        """Band keys of the given lines."""
        if not len(which):
            return np.zeros((0, BANDS), np.uint64)
        key, off = self.shingles(which)
        low = (key >> np.uint64(32)).astype(np.uint32)
        sig, own = np.empty((BANDS * ROWS, len(which)), np.uint32), np.empty_like(low)
        for j in range(BANDS * ROWS):
            np.multiply(np.bitwise_xor(low, _C[j], out=own), _A[j], out=own)
            np.minimum.reduceat(own, off[:-1], out=sig[j])
        sig = sig.astype(np.uint64).reshape(BANDS, ROWS, -1)
        out = np.full((BANDS, len(which)), 0, np.uint64)
        for r in range(ROWS):
            out = B.mix(out * np.uint64(0xD1342543DE82EF95) + sig[:, r] + np.uint64(r + 1))
        return B.mix(out + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc_key (hash of id and text) and the numbers of the lines that go, of documents that lose any."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc_key"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
        B.steady()
        for _, t in B.slices(batches, "text", CACHE_BYTES):
            x = Lines(t)
            first = np.sort(codes(x.name)[0])
            yield Items(x.name[first], np.ones(len(first), np.int64), x.bands(first).ravel(), np.repeat(np.arange(len(first)), BANDS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        B.steady()
        for _, t in B.slices(batches, "text", CACHE_BYTES):
            x = Lines(t)
            yield x.name, lambda at, t=t, x=x: [t.data[x.start[i] : x.end[i]].tobytes() for i in at]

    def expand(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
        return Lines(t).sets(np.arange(t.n))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.steady()
        for part, t in B.slices(batches, "text", CACHE_BYTES):
            x = Lines(t)
            yield pa.RecordBatch.from_arrays([binary(x.name), pa.array(short(x.name)), pa.array(x.size), part.column(0).take(pa.array(x.doc)), part.column(2).take(pa.array(x.doc)), pa.array(x.number)], ["node", "short", "size", "doc_id", "doc_key", "line"])

    lines = Kept(texts.mapInArrow(describe, f"node binary, short long, size long, doc_id {kind}, doc_key long, line long"))
    place = F.struct("doc_id", "doc_key", "line")
    classes = Kept(lines.df.groupBy("node", "short").agg(F.max("size").alias("size"), F.min(place).alias("keeper"), F.count("*").alias("n")))
    rows = classes.df.count() * BANDS
    found = Kept(clusters(texts.select("text"), keys, rows, PERCENT))
    release(spark)
    roots = Kept(links(texts.select("text"), sets, expand, found.df, classes.df.select("node", "short", "size"), PERCENT))
    found.drop()
    release(spark)
    # A component's keeper is the least of its classes'.
    joined = Kept(classes.df.join(roots.df, "node").select("node", "root", "keeper"))
    best = Kept(joined.df.groupBy("root").agg(F.min("keeper").alias("keeper")))
    near = joined.df.select("node", "root").join(best.df, "root").select("node", "keeper")
    equal = classes.df.where("n > 1").join(roots.df, "node", "left_anti").select("node", "keeper")
    verdict = Kept(near.union(equal))
    gone = lines.df.select("node", "doc_id", "doc_key", "line").join(verdict.df, "node").where(~place.eqNullSafe(F.col("keeper")))
    out = Kept(gone.groupBy("doc_id", "doc_key").agg(F.collect_set("line").alias("lines")))
    for x in (lines, classes, roots, joined, best, verdict):
        x.drop()
    release(spark)
    return out.df


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The documents, with all their columns, without the lines that go; n_chars follows the text if there is one.

    Lines without a character but white space stay. A document may lose all its
    lines and stays with an empty text; a null text stays null. Rows that repeat
    another's id and text count as one document and lose the same lines. One line
    is whole in memory, however long, and its cost grows with its length. With
    digest: doc_id, n_lines, n_removed and kept_sha256 of each document instead.
    """
    own, key, lines_ = (unused(docs, x) for x in ("id", "key", "lines"))
    gone = drops(docs, id_col, text_col).select(F.col("doc_id").alias(own), F.col("doc_key").alias(key), F.array_sort("lines").alias(lines_))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(id_col, text_col) == F.col(key)), "left").drop(own, key)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out, counts = [], []
            for text, lines in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                n = 0 if text is None else text.count("\n") + 1
                if lines:
                    no = set(lines)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in no)
                out.append(text)
                counts.append((n, len(lines or ())))
            if digest:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)), pa.array([n for n, _ in counts], pa.int64()), pa.array([m for _, m in counts], pa.int64()), pa.array([hashlib.sha256((x or "").encode()).hexdigest() for x in out], pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])
                continue
            cols = dict(zip(b.schema.names[:-1], b.columns[:-1], strict=True))
            cols[text_col] = pa.array(out, b.column(at).type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return both.mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string" if digest else docs.schema)
