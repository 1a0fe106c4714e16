"""Vectorised work on whole UTF-8 texts held in Arrow batches.

Everything here works on byte offsets of a slice of an Arrow string column, so
no Python object is made per character or per word. The word classes used by
the operators are ASCII classes plus "all non-ASCII", so byte tables are exact.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_R = 0x9E3779B97F4A7C1B
_RI = pow(_R, -1, 1 << 64)
#: A random odd 64-bit value for each byte.
_T = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pw = np.ones(1, np.uint64)
_ip = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ip
    if len(_pw) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_R, _RI):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pw, _ip = out
    return _pw[:n], _ip[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit words that spreads every bit."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def trim() -> None:
    """Gives freed memory back to the system: a worker is kept for later tasks beside other workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def steady() -> None:
    """Lets the process keep up to 24 MB of freed memory, so that the arrays of a slice aren't mapped anew for each; those above 4 MB go back at once."""
    with contextlib.suppress(OSError, AttributeError):  # as above
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 24 << 20)  # M_TRIM_THRESHOLD


class Texts:
    """A run of texts: their bytes back to back and their offsets."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1

    def prefix(self) -> np.ndarray:
        """Prefix sums of a polynomial fingerprint modulo 2^64."""
        p = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_T[self.data] * _powers(len(self.data))[0], out=p[1:])
        return p

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, "right") - 1


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of the bytes start..end of each span; an empty span gives mix(0)."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start])


def texts_of(arr: pa.Array) -> Texts:
    """Null texts count as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if bufs[1] is not None and len(arr) else np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches into row slices of at most `most` bytes of text, or one row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        lens = pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, texts_of(part.column(i))
            at = to
    trim()


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Joins rows across batches to runs of about `most` bytes of text; one longer text makes a run of its own."""
    held, size = [], 0
    for part, t in slices(batches, column, most):
        if held and size + len(t.data) > most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole, texts_of(whole.column(whole.schema.get_field_index(column)))
            held, size = [], 0
        held.append(part)
        size += len(t.data)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, texts_of(whole.column(whole.schema.get_field_index(column)))


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs that don't cross texts, and the runs' offsets by text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = off[:-1][off[:-1] < len(mask)]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[edge] = mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = mask[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def table(keep) -> np.ndarray:
    """A byte table from a predicate over 0..255."""
    return np.array([bool(keep(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
SPACED = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def lowered(t: Texts) -> Texts:
    return Texts(LOWER[t.data], t.off)


def words(t: Texts, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(kind[t.data], t.off)


_Q = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(256)], np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of k consecutive items; the i-th starts at item i and may cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _Q[0]
    for j in range(1, k):
        out = out + h[j : j + n] * _Q[j]
    return mix(out)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, in integers."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:], dtype=np.int64)
    return c[off[1:]] - c[off[:-1]]


def ids(counts: np.ndarray) -> np.ndarray:
    """0 counts[0] times, 1 counts[1] times, and so on."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0].. for count[0] items, start[1].. for count[1] items, and so on."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(start, count)


#: Bytes of text whose shingles are made at once; the working memory is some 100 times as large.
SHINGLE_BYTES = 512 << 10


def shingles(t: Texts, k: int, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text and their offsets.

    With fewer words the whole sequence is the one shingle; without words the
    set is empty.
    """
    keys, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < t.n:
        to = max(at + 1, int(np.searchsorted(t.off, t.off[at] + SHINGLE_BYTES, "right")) - 1)
        key, off = _shingles(Texts(t.data[t.off[at] : t.off[to]], t.off[at : to + 1] - t.off[at]), k, kind)
        keys.append(key)
        sizes.append(np.diff(off))
        at = to
    return np.concatenate(keys), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _shingles(t: Texts, k: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ws, we, woff = words(t, kind)
    h = span_hash(t.prefix(), ws, we)
    n = np.diff(woff)
    full = np.maximum(n - k + 1, 0)
    g = grams(h, k)
    parts, docs = [g[ranges(woff[:-1][full > 0], full[full > 0])]], [np.repeat(np.flatnonzero(full > 0), full[full > 0])]
    for m in range(1, k):
        if len(d := np.flatnonzero(n == m)):
            parts.append(grams(h, m)[woff[d]] ^ np.uint64(m))
            docs.append(d)
    key, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(t.n + 1))
