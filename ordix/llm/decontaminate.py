"""Benchmark decontamination by training suffix arrays.

Each slice of documents is a shard with a suffix array of its own over word
ids; every test suffix is looked up in it by binary search. Ids are ranks in the
benchmark's vocabulary, so a training suffix is left out of the array only if a
word too early in it occurs in no test item and nothing could match it. The
benchmark is broadcast in blocks of a checked size; shards take one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import prepare

#: Words in a window; a shorter item is one window.
N = 10
#: Bytes of benchmark text that are broadcast as one block, and blocks that a worker holds; with more of them it holds one at a time.
BLOCK_BYTES = 16 << 20
HELD = 4


@dataclass
class Index:
    """A block of the benchmark: its vocabulary and its distinct windows."""

    vocabulary: np.ndarray  # sorted word fingerprints; ids are ranks from 1
    words: np.ndarray  # of all windows, one after the other
    start: np.ndarray
    length: np.ndarray
    place_off: np.ndarray  # by window, into item and place
    item: np.ndarray
    place: np.ndarray  # word of the item at which the window starts
    names: list[str]


def build(names: list[str], texts: list[str], n: int = N) -> Index:
    t = B.lowered(B.texts_of(pa.array(texts, pa.large_string())))
    ws, we, off = B.words(t, B.ALNUM)
    h = B.span_hash(t.prefix(), ws, we)
    vocabulary, words = np.unique(h, return_inverse=True)
    words = words.astype(np.int64) + 1
    count = np.diff(off)
    length = np.minimum(count, n)
    windows = np.where(count > 0, count - length + 1, 0)
    start = B.ranges(off[:-1], windows)
    item = np.repeat(np.arange(len(names)), windows)
    long = length[item]
    seen: dict[tuple[int, ...], int] = {}
    which = np.array([seen.setdefault(tuple(words[a : a + m]), len(seen)) for a, m in zip(start.tolist(), long.tolist(), strict=True)], np.int64)
    order = np.argsort(which, kind="stable")
    first = order[np.searchsorted(which[order], np.arange(len(seen)))] if len(seen) else order
    return Index(vocabulary, words, start[first], long[first], np.searchsorted(which[order], np.arange(len(seen) + 1)), item[order], (start - off[item])[order], names)


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> list[Broadcast]:
    """The benchmark's blocks; more of them, not larger ones, when it grows. Null texts have no words; a null id is the empty name; rows that repeat count once."""
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    out = []
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect()
        out.append(bench.sparkSession.sparkContext.broadcast(build([r.i for r in got], [r.t for r in got], n)))
    return out


def _value(b: Broadcast, blocks: int) -> Index:
    """A worker holds HELD blocks; of more than that it holds one at a time."""
    own = b.value
    if blocks > HELD and "_value" in vars(b) and vars(b).get("_path"):
        del b._value
    return own


class Shard:
    """The words of a run of documents, each followed by a word that matches nothing."""

    def __init__(self, t: B.Texts):
        t = B.lowered(t)
        ws, we, off = B.words(t, B.ALNUM)
        self.n_words = np.diff(off)
        self.off = off + np.arange(t.n + 1)  # with the separators
        self.hash = B.span_hash(t.prefix(), ws, we)
        self.at = np.arange(len(ws)) + B.ids(self.n_words)

    def search(self, x: Index) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a window: the word of the shard at which it starts, and the window.

        A window is what a match of a test suffix needs at least; test suffixes
        that begin with the same window are looked up once.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(x.length):
            return none
        rank = np.minimum(np.searchsorted(x.vocabulary, self.hash), len(x.vocabulary) - 1)
        text = np.zeros(self.off[-1], np.int64)
        text[self.at] = np.where(x.vocabulary[rank] == self.hash, rank + 1, 0)
        # Suffixes that go on for long enough to hold the shortest window.
        zero = np.flatnonzero(text == 0)
        pos = np.flatnonzero(text)
        pos = pos[zero[np.searchsorted(zero, pos)] - pos >= x.length.min()]
        if not len(pos):
            return none
        depth = int(x.length.max())
        bits = int(len(x.vocabulary)).bit_length()
        each = 63 // bits
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        known = np.concatenate([x.words, np.zeros(depth, np.int64)])
        columns, low, high = [], [], []
        for a in range(0, depth, each):
            col, lo, hi = np.zeros(len(pos), np.int64), np.zeros(len(x.length), np.int64), np.zeros(len(x.length), np.int64)
            for j in range(a, min(a + each, depth)):
                inside = j < x.length
                w = known[x.start + j]
                col = (col << bits) | padded[pos + j]
                lo = (lo << bits) | np.where(inside, w, 0)
                hi = (hi << bits) | np.where(inside, w, (1 << bits) - 1)
            columns.append(col)
            low.append(lo)
            high.append(hi)
        order = np.lexsort(columns[::-1])
        a, z = np.zeros(len(x.length), np.int64), np.full(len(x.length), len(pos))
        for col, lo, hi in zip(columns, low, high, strict=True):
            col = col[order]
            a, z = _bisect(col, a, z, lo, False), _bisect(col, a, z, hi, True)
        found = np.maximum(z - a, 0)
        return pos[order][B.ranges(a, found)], np.repeat(np.arange(len(found)), found)


def _bisect(col: np.ndarray, a: np.ndarray, z: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """For each key its place in col[a:z], which is sorted."""
    a, z = a.copy(), z.copy()
    while (open_ := a < z).any():
        mid = (a + z) >> 1
        got = col[np.minimum(mid, len(col) - 1)]
        up = open_ & ((got <= key) if right else (got < key))
        a = np.where(up, mid + 1, a)
        z = np.where(open_ & ~up, mid, z)
    return a


def _matches(shard: Shard, x: Index, pos: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches from the occurrences of windows: document, item, first word in both, and words.

    An occurrence is one of every test suffix that begins with its window. Those
    of neighbouring suffixes of an item at neighbouring words of a document make
    one match, which ends where the next word differs on either side.
    """
    many = (x.place_off[1:] - x.place_off[:-1])[window]
    place = B.ranges(x.place_off[window], many)
    pos, window = np.repeat(pos, many), np.repeat(window, many)
    item, at = x.item[place], x.place[place]
    order = np.lexsort((pos, pos - at, item))
    pos, item, at, long = pos[order], item[order], at[order], x.length[window][order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | ((pos - at)[1:] != (pos - at)[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1 if len(first) else first
    doc = np.searchsorted(shard.off, pos[first], "right") - 1
    return doc, item[first], pos[first] - shard.off[doc], at[first], pos[last] - pos[first] + long[first]


def _judge(t: B.Texts, index: list[Broadcast]) -> tuple[Shard, np.ndarray, list[set[str]], np.ndarray]:
    """Words hit by document, the names of the items found in each, and the words of its longest match."""
    shard = Shard(t)
    edge = np.zeros(int(shard.off[-1]) + 1, np.int64)
    names: list[set[str]] = [set() for _ in range(t.n)]
    longest = np.zeros(t.n, np.int64)
    for b in index:
        x = _value(b, len(index))
        pos, window = shard.search(x)
        if not len(pos):
            continue
        doc, item, _, _, words = _matches(shard, x, pos, window)
        # A match covers the words of all its windows.
        np.maximum.at(longest, doc, words)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + x.length[window], -1)
        pair = np.unique(doc * len(x.names) + item)
        for d, i in zip((pair // len(x.names)).tolist(), (pair % len(x.names)).tolist(), strict=True):
            names[d].add(x.names[i])
    return shard, B.sums(np.cumsum(edge[:-1]) > 0, shard.off), names, longest


def report(docs: DataFrame, index: list[Broadcast], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, the verdict, and the words of its longest match.

    Null or empty texts have no words and are clean; repeated rows each get a
    row; other columns aren't read. With an empty benchmark all are clean. A text
    is whole in a shard, however long.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.slices(batches, "text"):
            shard, hit, names, longest = _judge(t, index)
            found = [sorted(x) for x in names]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shard.n_words), pa.array(hit), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]), pa.array(hit > 0), pa.array(longest)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def matches(docs: DataFrame, index: list[Broadcast], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, first word in the document and in the item, words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.slices(batches, "text"):
            shard = Shard(t)
            for b in index:
                x = _value(b, len(index))
                doc, item, doc_word, item_word, words = _matches(shard, x, *shard.search(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array([x.names[i] for i in item], pa.string()), pa.array(doc_word), pa.array(item_word), pa.array(words)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")


def clean(docs: DataFrame, index: list[Broadcast], text_col: str = "text") -> DataFrame:
    """The documents without a match, with all their columns."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in B.slices(batches, text_col):
            yield part.filter(pa.array(_judge(t, index)[1] == 0))

    return docs.mapInArrow(run, docs.schema)
