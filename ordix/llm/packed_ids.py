"""Token-ID output: ids bit-packed at the minimum vocabulary width, with block offsets.

A dataset is a folder of Parquet files whose rows are shards; `data` of a shard
is one self-describing run of bytes:

    bytes 0-7    b"OXPK0001"
    then         little-endian uint64: bits an id, ids a block, documents, ids, bytes of the packed part
    then         documents + 1 uint64: first id of each document, counted in the shard
    then         blocks + 1 uint64: byte at which each block begins in the packed part
    then         the packed part; every block begins at a byte

Shards hold documents in ascending id order and come in that order by (part,
shard). Any id range is read by unpacking only the blocks that hold it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import prepare

MAGIC = b"OXPK0001"
#: Ids in a block: random access unpacks at least so many.
BLOCK_IDS = 4096
#: A shard is closed at so many ids.
SHARD_IDS = 1 << 20
#: Bytes of text that a part of the output is given, about.
PART_BYTES = 32 << 20
#: Fine ranges of document ids among which parts are balanced, at least and at most.
RANGES, MOST_RANGES = 2000, 20_000
#: Bytes of text encoded together.
SLICE_BYTES = 1 << 20
#: Words whose ids a worker remembers, and the bytes of the longest such word.
REMEMBERED = 400_000
LONGEST = 64
#: New words that are encoded as one text.
JOINED = 64


# --- the format ---------------------------------------------------------------


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(ids: np.ndarray, starts: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """starts: first id of each document, and the number of ids."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64)))
    head = np.array([bits, block, len(starts) - 1, len(ids), offsets[-1]], "<u8")
    return b"".join([MAGIC, head.tobytes(), starts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.bits, self.block, self.docs, self.ids, size = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        at = 48
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        n = -(-self.ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.data = data[at : at + size]

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi; only their blocks are unpacked."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        out = [unpack(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


# --- encoding -----------------------------------------------------------------


#: White space that a word may not begin with, as up to three bytes; any superset is safe.
_BLANK = B.table(lambda b: 9 <= b <= 13 or 28 <= b <= 31)
#: Bytes of ASCII letters and of two-byte letters from U+00C0 to U+023F, of which the two signs among them are told by their second byte.
_LETTER = B.table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC8)
_STOPS = b".,"
#: A second random value for each byte, for the other half of a word's fingerprint.
_T2 = np.random.Generator(np.random.PCG64(50)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AFTER = re.compile(r" (?=\S)")


def _blank(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs begin with white space of any kind."""
    at = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c = at[start], at[start + 1], at[start + 2]
    return _BLANK[a] | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81)) | ((a == 0xE3) & (b == 0x80))


class _Encoder:
    """Ids of texts; words that come again are encoded once.

    A byte-level vocabulary whose split rule lets a space begin a word never
    joins anything over a space that a non-space follows. So words are told by
    128-bit fingerprints, new ones are encoded many at a time as one text and
    told apart by their spaces, and a text's ids are gathered from those of its
    words. A stop after letters is a word of its own. Texts with spaces in a row
    or before other white space are split where it is sure; those that hold a
    special string go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        rule = spec.get("pre_tokenizer") or {}
        self.safe = spec.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.vocabulary = max(self.model.get_vocab(with_added_tokens=True).values()) + 1
        # In joined words, the ids that hold a space begin the words.
        self.begins = np.zeros(self.vocabulary, bool)
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.begins[i] = "Ġ" in token
        self.stops = self.encode(list(_STOPS.decode()))
        self._forget(np.zeros(0, np.int64), first=True)

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]

    # Remembered words: fingerprints in ascending order, and where and how many their ids are.

    def _forget(self, keep: np.ndarray, first: bool = False) -> None:
        """Keeps only the chosen words."""
        if first:
            self.flat, self.name, self.check = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            self.at = self.n = np.zeros(0, np.int64)
        else:
            self.flat, self.name, self.check = self.flat[B.ranges(self.at[keep], self.n[keep])], self.name[keep], self.check[keep]
            self.n = self.n[keep]
            self.at = np.cumsum(self.n) - self.n
        self.used = np.zeros(len(self.name), bool)

    def _remember(self, name: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Adds words in ascending order, whose ids are in flat already; beyond REMEMBERED those that came again outlive the others."""
        to = np.searchsorted(self.name, name)
        self.name, self.check, self.at, self.n, self.used = (np.insert(x, to, y) for x, y in ((self.name, name), (self.check, check), (self.at, at), (self.n, n), (self.used, False)))
        if len(self.name) > REMEMBERED:
            keep = np.flatnonzero(self.used)
            self._forget(keep if len(keep) <= REMEMBERED // 2 else keep[:0])

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space each, one after the other, and their numbers."""
        joined = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        ids, starts, base = [], [], 0
        for part, got in zip(joined, self.encode([" " + " ".join(p) for p in joined]), strict=True):
            start = np.flatnonzero(self.begins[got])
            if len(start) != len(part):
                raise ValueError("the vocabulary joins words over a space")
            ids.append(got)
            starts.append(start + base)
            base += len(got)
        return np.concatenate(ids), np.diff(np.append(np.concatenate(starts), base))

    def ids(self, t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and their offsets."""
        blob = t.data.tobytes()
        start, end, off = B.runs(t.data != 0x20, t.off)
        plain = (np.diff(off) == B.sums(t.data == 0x20, t.off) + 1) & (B.sums(_blank(t.data, start), off) == 0) & self.safe
        whole = np.full(t.n, not self.safe)
        for s in self.special:
            at = blob.find(s)
            while at >= 0:
                whole[t.doc_of(np.array([at]))] = True
                at = blob.find(s, at + 1)
        plain &= ~whole
        heads = off[:-1][plain]
        texts = [blob[a:z].decode() for a, z in zip(t.off[:-1][~plain].tolist(), t.off[1:][~plain].tolist(), strict=True)]
        parts, of = [blob[a:z].decode() for a, z in zip(start[heads].tolist(), end[heads].tolist(), strict=True)], [np.flatnonzero(plain)]
        for d, text in zip(np.flatnonzero(~plain).tolist(), texts, strict=True):
            if text:
                first, *rest = [text] if whole[d] else _AFTER.split(text)
                parts += [first, *(" " + p for p in rest)]
                of.append(np.full(1 + len(rest), d))
        apart = self.encode(parts) if parts else []

        # The words after the first of plain texts, and the stops that are taken off them.
        doc = B.ids(np.diff(off))
        rest = plain[doc]
        rest[heads] = False
        start, end, doc = start[rest], end[rest], doc[rest]
        letters = np.zeros(len(t.data) + 1, np.int32)
        sign = np.zeros(len(t.data), bool)
        sign[1:] = (t.data[:-1] == 0xC3) & ((t.data[1:] == 0x97) | (t.data[1:] == 0xB7))
        np.cumsum(_LETTER[t.data] & ~sign, out=letters[1:])
        last = t.data[end - 1]
        stopped = np.isin(last, list(_STOPS)) & (end - start > 1) & (letters[end - 1] - letters[start] == end - 1 - start)
        end = end - stopped
        prefix = t.prefix()
        name = B.span_hash(prefix, start, end)
        np.cumsum(_T2[t.data] * B._powers(len(t.data))[0], out=prefix[1:])
        check = B.span_hash(prefix, start, end)
        distinct, first, which = np.unique(name, return_index=True, return_inverse=True)
        own = check[first]
        if (own[which] != check).any():
            raise ValueError("two words of one fingerprint in a slice")
        place = np.minimum(np.searchsorted(self.name, distinct), max(0, len(self.name) - 1))
        held = (self.name[place] == distinct) & (self.check[place] == own) if len(self.name) else np.zeros(len(distinct), bool)
        self.used[place[held]] = True
        at, n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        at[held], n[held] = self.at[place[held]], self.n[place[held]]
        new = np.flatnonzero(~held)
        flat = self.flat
        if len(new):
            long = (end - start)[first[new]]
            ids, n[new] = self.learn([blob[a:z].decode() for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            at[new] = np.cumsum(n[new]) - n[new] + len(flat)
            flat = np.concatenate([flat, ids])

        # Pieces in order: what is encoded apart, words and stops.
        base = np.cumsum([len(flat), *(len(x) for x in (*self.stops, *apart))])
        pool = np.concatenate([flat, *self.stops, *apart])
        sized = np.array([len(x) for x in (*self.stops, *apart)], np.int64)
        stop = np.searchsorted(np.sort(list(_STOPS)), last[stopped])
        stop = np.argsort(list(_STOPS))[stop]
        order = np.concatenate([np.repeat(np.int64(-1), len(apart)), np.arange(len(start)) * 2, np.flatnonzero(stopped) * 2 + 1])
        docs = np.concatenate([*of, doc, doc[stopped]]).astype(np.int64)
        begin = np.concatenate([base[len(self.stops) : -1], at[which], base[stop]])
        many = np.concatenate([sized[len(self.stops) :], n[which], sized[stop]])
        order = np.lexsort((order, docs))
        out = pool[B.ranges(begin[order], many[order])]
        if len(new):
            short = new[long <= LONGEST]
            self.flat = flat
            self._remember(distinct[short], own[short], at[short], n[short])
        return out, np.concatenate(([0], np.cumsum(np.bincount(docs, many, t.n).astype(np.int64))))


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _bounds(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that begin the ranges of ids, the first part of each range (that of null ids first), and how many parts each has.

    Fine ranges are joined to about PART_BYTES of text each. An id on very many
    rows is a range of its own, which has parts by the hash of the text.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"), F.octet_length(text_col).alias("b"))
    total = ids.agg(F.sum("b")).first()[0] or 0
    ranges = min(MOST_RANGES, max(RANGES, 4 * total // PART_BYTES))
    most = max(PART_BYTES, total // MOST_RANGES)
    edges = ids.where("i IS NOT NULL").agg(F.percentile_approx("i", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("e")).first().e
    edges, often = np.unique(np.array(edges or [], np.int64), return_counts=True)
    hot = edges[often > 1]
    edges = np.unique(np.concatenate([edges, hot + 1]))
    # The sizes of the ranges come to the driver: MOST_RANGES at most, and as many for hot ids.
    sizes = {r.r: r.b or 0 for r in ids.mapInArrow(_ranged(edges), "r long, b long").groupBy("r").agg(F.sum("b").alias("b")).collect()}
    bounds, subs, held = [], [max(1, -(-sizes.get(-1, 0) // most))], 0
    open_ = True  # whether the range at the end may be gone on with
    subs.append(1)
    held = sizes.get(0, 0)
    for k, e in enumerate(edges):
        size, alone = sizes.get(k + 1, 0), bool(np.isin(e, hot)) and sizes.get(k + 1, 0) > most
        if alone or not open_ or held >= most:
            bounds.append(e)
            subs.append(max(1, -(-size // most)) if alone else 1)
            held, open_ = 0, not alone
        held += size
    subs = np.array(subs, np.int64)
    return np.array(bounds, np.int64), np.cumsum(subs) - subs, subs


def _ranged(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 2
        for b in batches:
            size = b.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            r = np.where(known, np.searchsorted(edges, b.column(0).fill_null(0).to_numpy(zero_copy_only=False), "right"), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) - 1), pa.array(np.bincount(r + 1, size, n).astype(np.int64))], ["r", "b"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the dataset to `path`.

    tokenizer: path of a tokenizers file that every executor has. Document ids
    are integers. Documents come in ascending id order, null ids first; rows of
    the same id by their part of the text's hash, if they are too many for one
    task, and then by their number of ids and these. A null or empty text has the
    end id only. A text is whole in memory; rows that repeat each have a place.
    The one shuffle carries packed ids, dealt into parts of about PART_BYTES of text.
    """
    prepare(docs.sparkSession)
    bounds, firsts, subs = _bounds(docs, id_col, text_col)
    own = _encoder(tokenizer)
    bits = width(max(own.vocabulary, (end_id or 0) + 1))
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(tokenizer)
        for part, t in B.slices(batches, "text", SLICE_BYTES):
            ids, off = model.ids(t)
            if end_id is not None:
                ids, off = np.insert(ids, off[1:], np.uint32(end_id)), off + np.arange(len(off))
            key = part.column(0)
            r = np.where(key.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(bounds, key.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1, 0)
            # The upper half of the hash as a share of the range's parts.
            to = firsts[r] + ((part.column(2).to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64) * subs[r] >> 32)
            if bits in (8, 16, 32):
                size = bits // 8
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((off * size).astype(np.int64)), pa.py_buffer(pack(ids, bits))]).cast(pa.binary())
            else:
                data = pa.array([pack(ids[a:z], bits) for a, z in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), key, pa.array(np.diff(off)), data], ["part", "doc_id", "n", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first, held, docs_, keys = None, 0, 0, 0, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, first, held, docs_, keys
            if keys:
                ids = np.concatenate(docs_) if docs_ else np.zeros(0, np.uint32)
                starts = np.concatenate(([0], np.cumsum([len(x) for x in docs_], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([write_shard(ids, starts, bits)], pa.binary())], ["part", "shard", "first", "n_ids", "doc_ids", "data"])
            shard, first, held, docs_, keys = shard + 1, first + held, 0, [], []

        for b in batches:
            for p, i, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    yield from close()
                    part, shard, first = p, 0, 0
                keys.append(i)
                docs_.append(unpack(x, bits, n))
                held += n
                if held >= SHARD_IDS:
                    yield from close()
        yield from close()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
        .mapInArrow(encode, "part int, doc_id long, n long, ids binary")
        .repartitionById(int(subs.sum()), "part")
        .sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), "n", "ids")
        .mapInArrow(shards, "part int, shard long, first long, n_ids long, doc_ids array<long>, data binary")
        .write.mode("overwrite")
        .option("compression", "uncompressed")
        .parquet(path)
    )


# --- reading ------------------------------------------------------------------


def read(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's documents, from its files: doc_id, start, n_tokens and ids_crc32."""
    files = spark.read.parquet(path)
    # One row a part: as many as bounds were made on the driver.
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    parts = np.array([p for p, _ in totals], np.int64)
    before = np.concatenate(([0], np.cumsum([n for _, n in totals], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, keys, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                s = Shard(data.as_buffer())
                ids = s.read(0, s.ids).astype("<u4")
                start = s.starts
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(start[:-1], start[1:], strict=True)]
                at = before[np.searchsorted(parts, part)] + first + start[:-1]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(at), pa.array(np.diff(start)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "first", "doc_ids", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
