"""Exact substring dedup of whole texts by difference-cover suffix buckets.

A suffix counts here only by its first LENGTH bytes, so equal ranks are all that
is needed of the suffix order, and a rank is a 64-bit fingerprint of the prefix.
Whole strings are equal when a second, independent fingerprint agrees as well.

1. Cover sample. Positions whose residue is in a difference cover modulo PERIOD
   are ranked by their first LENGTH - PERIOD + 1 bytes. For any two positions
   there is a shift below PERIOD that takes both into the sample, so a repeated
   LENGTH-byte string always holds a sampled position whose rank comes twice.
   Most suffixes of a corpus are settled here: no sampled rank near them does.
2. Suffix buckets. The suffixes left are ordered by their full LENGTH bytes, one
   bucket of ranks at a time: ROUNDS rounds, each with only its part of the
   suffixes in the exchange, sorted in tasks of about BUCKET_KEYS.

Texts take part once however often they are copied. Chunks of texts send each
rank once, with a mark if they hold it twice, and get back one bit a rank. Chunks
and buckets grow with the root of the corpus (see sized).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._dist import Kept, prepare, release, sized, summed
from .candidates import FILTER_WORDS, binary, codes, names

#: Bytes of a string that may not come twice.
LENGTH = 200
#: A perfect difference set: every residue modulo PERIOD is a difference of two of COVER.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
ROUNDS = 4
#: Keys of a bucket, about, and bytes of text in a chunk, at least and at most.
BUCKET_KEYS = 1_000_000, 16_000_000
CHUNK_BYTES = 2 << 20, 8 << 20

_EMPTY = hashlib.sha256(b"").hexdigest()
_SAMPLED = np.isin(np.arange(PERIOD), COVER)
#: A second random value for each byte, for the fingerprint that verifies equal ranks.
_T2 = np.random.Generator(np.random.PCG64(91)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _names(t: B.Texts) -> np.ndarray:
    """First 128 bits of each text's SHA-256."""
    data = t.data.tobytes()
    out = b"".join(hashlib.sha256(data[a:z]).digest()[:16] for a, z in zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True))
    return np.frombuffer(out, ">u8").astype(np.uint64).reshape(-1, 2)


def _window_keys(t: B.Texts, pos: np.ndarray, length: int) -> np.ndarray:
    p = t.prefix()
    return B.span_hash(p, pos, pos + length)


def _checks(t: B.Texts, pos: np.ndarray) -> np.ndarray:
    """The second fingerprint of the strings at these positions."""
    p = np.zeros(len(t.data) + 1, np.uint64)
    np.cumsum(_T2[t.data] * B._powers(len(t.data))[0], out=p[1:])
    return B.span_hash(p, pos, pos + LENGTH)


def _sorted(key: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, by their checks where keys are equal and checks are not, and which are equal to the one before."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    if check is not None:
        c = check[order]
        if (same[1:] & (c[1:] != c[:-1])).any():
            order = np.lexsort((check, key))
            c = check[order]
            same[1:] &= c[1:] == c[:-1]
    return order, same


def _split(key: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges begins in ascending keys, and the end."""
    bounds = [(k << 64) // parts for k in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(key, np.array(bounds, np.uint64)), [len(key)]))


def _once(key: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (and checks) ascending, which of them came twice, the place of each key, and one position of each distinct key."""
    order, same = _sorted(key, check)
    new = ~same
    rank = np.cumsum(new) - 1
    place = np.empty(len(key), np.int64)
    place[order] = rank
    first = order[new]
    return key[first], np.bincount(rank, minlength=len(first)) > 1, place, first


# --- 1. the cover sample ------------------------------------------------------


def _samples(t: B.Texts) -> np.ndarray:
    """Sampled positions with LENGTH - PERIOD + 1 bytes left, of texts long enough to hold a string."""
    long = np.diff(t.off)
    n = np.where(long >= LENGTH, long - (LENGTH - PERIOD), 0)
    at = B.ranges(t.off[:-1], n)
    inside = B.ranges(np.zeros(t.n, np.int64), n)
    return at[_SAMPLED[inside % PERIOD]]


_SENT = "bucket long, chunk binary, keys binary, twice binary, places binary, names binary, off binary"


def _send_samples(buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in B.chunks(batches, "text", chunk_bytes):
            pos = _samples(t)
            if not len(pos):
                continue
            key, twice, place, _ = _once(_window_keys(t, pos, LENGTH - PERIOD + 1))
            name = _names(t)
            chunk = hashlib.sha256(name.tobytes()).digest()[:16]
            ends = _split(key, buckets)
            bucket_of = np.searchsorted(ends[1:-1], place, "right")
            order = np.argsort(bucket_of, kind="stable")
            at = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                a, z = ends[k], ends[k + 1]
                own = order[at[k] : at[k + 1]]
                home = k == chunk[0] % buckets
                if z > a or home:
                    # Inside a bucket 32 bits of the rank do: a false repeat only lets more suffixes by.
                    rows.append((k, chunk, (key[a:z] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(twice[a:z]).tobytes(), _places(pos[own], place[own] - a), name.tobytes() if home else None, t.off.tobytes() if home else None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], [x.split()[0] for x in _SENT.split(", ")])

    return run


def _places(pos: np.ndarray, rank: np.ndarray) -> bytes:
    """Positions in the order of their ranks, as steps of ranks and positions."""
    order = np.argsort(rank, kind="stable")
    return np.concatenate([np.array([len(pos)]), np.diff(rank[order], prepend=0), pos[order]]).astype(np.int32).tobytes()


def _mark(keys: list[np.ndarray], twice: list[np.ndarray], checks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Which keys (with their checks) of each chunk come twice, there or in another chunk."""
    if not keys:
        return []
    order, same = _sorted(np.concatenate(keys), np.concatenate(checks) if checks else None)
    same[:-1] |= same[1:].copy()
    out = np.zeros(len(order), bool)
    out[order] = same
    out |= np.concatenate(twice)
    return np.split(out, np.cumsum([len(x) for x in keys])[:-1])


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _judge_samples(t: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
    twice = [_bits(x, len(k)) for x, k in zip(t.column("twice").to_pylist(), keys, strict=True)]
    out = []
    for hit, places in zip(_mark(keys, twice), t.column("places").to_pylist(), strict=True):
        p = np.frombuffer(places, np.int32)
        n = int(p[0])
        rank, pos = np.cumsum(p[1 : n + 1]), p[n + 1 :]
        out.append(pos[hit[rank]].tobytes() if n else b"")
    return pa.table({"chunk": t.column("chunk"), "pos": pa.array(out, pa.binary()), "names": t.column("names"), "off": t.column("off")})


def _by_text(t: pa.Table) -> pa.Table:
    """A chunk's repeated samples, dealt to its texts."""
    pos = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in t.column("pos").to_pylist()]))
    at = next(i for i, x in enumerate(t.column("names").to_pylist()) if x is not None)
    name = np.frombuffer(t.column("names")[at].as_py(), np.uint64).reshape(-1, 2)
    off = np.frombuffer(t.column("off")[at].as_py(), np.int64)
    doc = np.searchsorted(off, pos, "right") - 1
    ends = np.searchsorted(doc, np.arange(len(name) + 1))
    held = np.flatnonzero(np.diff(ends))
    return pa.table({"name": binary(name[held]), "samples": pa.array([(pos[ends[i] : ends[i + 1]] - off[i]).astype(np.int32).tobytes() for i in held], pa.binary())})


# --- 2. suffix buckets --------------------------------------------------------

_CHUNK = "chunk long, windows long, names binary, text binary, off binary, samples binary"


def _suffixes(t: B.Texts, samples: np.ndarray) -> np.ndarray:
    """Positions of whole strings that hold a repeated sample less than PERIOD after their start."""
    edge = np.zeros(len(t.data) + 1, np.int64)
    doc = t.doc_of(samples)
    np.add.at(edge, np.maximum(samples - PERIOD + 1, t.off[doc]), 1)
    np.add.at(edge, samples + 1, -1)
    open_ = np.cumsum(edge[:-1]) > 0
    long = np.diff(t.off)
    at = B.ranges(t.off[:-1], np.maximum(long - LENGTH + 1, 0))
    return at[open_[at]]


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES[0]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated samples, packed into chunks."""
    for part, t in B.chunks(batches, "text", chunk_bytes):
        own = [np.frombuffer(x, np.int32).astype(np.int64) for x in part.column(2).to_pylist()]
        samples = np.concatenate([x + o for x, o in zip(own, t.off, strict=False)])
        name = b"".join(part.column(0).to_pylist())
        chunk = int.from_bytes(hashlib.sha256(name).digest()[:8], "little", signed=True)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(_suffixes(t, samples))], pa.int64()), *(pa.array([x], pa.binary()) for x in (name, t.data.tobytes(), t.off.tobytes(), samples.tobytes()))], [x.split()[0] for x in _CHUNK.split(", ")])


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[B.Texts, np.ndarray]:
    text, off, samples = (b.column(k)[i].as_py() for k in ("text", "off", "samples"))
    t = B.Texts(np.frombuffer(text, np.uint8), np.frombuffer(off, np.int64))
    return t, _suffixes(t, np.frombuffer(samples, np.int64))


_RANKS = "bucket long, chunk long, keys binary, checks binary, twice binary"


def _send_ranks(round_: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, pos = _unpacked(b, i)
                if not len(pos):
                    continue
                check = _checks(t, pos)
                key, twice, _, first = _once(_window_keys(t, pos, LENGTH), check)
                check = check[first]
                ends = _split(key, ROUNDS * buckets)
                rows = [(k, b.column("chunk")[i].as_py(), key[ends[k] : ends[k + 1]].tobytes(), check[ends[k] : ends[k + 1]].tobytes(), np.packbits(twice[ends[k] : ends[k + 1]]).tobytes()) for k in range(round_ * buckets, (round_ + 1) * buckets) if ends[k + 1] > ends[k]]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], [x.split()[0] for x in _RANKS.split(", ")])

    return run


def _judge_ranks(t: pa.Table) -> pa.Table:
    keys, checks = ([np.frombuffer(x, np.uint64) for x in t.column(c).to_pylist()] for c in ("keys", "checks"))
    twice = [_bits(x, len(k)) for x, k in zip(t.column("twice").to_pylist(), keys, strict=True)]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "hit": pa.array([np.packbits(x).tobytes() for x in _mark(keys, twice, checks)], pa.binary())})


_RESULT = "name binary, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"


def _spans(buckets: int):
    """What goes from each text of a chunk; the bits come in the order of the sorted ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, pos = _unpacked(b, i)
                covered = np.zeros(len(t.data) + 1, np.int64)
                if len(pos):
                    key, _, place, _ = _once(_window_keys(t, pos, LENGTH), _checks(t, pos))
                    ends = _split(key, ROUNDS * buckets)
                    hit = np.zeros(len(key), bool)
                    for r in b.column("hits")[i].as_py() or ():
                        a, z = ends[r["bucket"]], ends[r["bucket"] + 1]
                        hit[a:z] = _bits(r["hit"], z - a)
                    start = pos[hit[place]]
                    covered[start] += 1
                    covered[start + LENGTH] -= 1
                gone = np.cumsum(covered[:-1]) > 0
                s, e, off = B.runs(gone, t.off)
                data, keep = t.data, ~gone
                out = []
                for d in range(t.n):
                    a, z = t.off[d], t.off[d + 1]
                    out.append((hashlib.sha256(data[a:z][keep[a:z]].tobytes()).hexdigest(), np.stack([s[off[d] : off[d + 1]], e[off[d] : off[d + 1]]], axis=1).ravel() - a))
                name = np.frombuffer(b.column("names")[i].as_py(), ">u8").astype(np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([binary(name), pa.array(B.sums(gone, t.off)), pa.array(np.diff(off)), pa.array([h for h, _ in out], pa.string()), pa.array([x.tolist() for _, x in out], pa.list_(pa.int64()))], ["name", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes when a LENGTH-byte string over it also starts anywhere else, in
    the same document or another; spans lists the starts and ends of maximal
    removed runs, in bytes. Repeated rows are documents: each makes the other
    go. A null or empty text has no bytes; shorter texts lose none. Other
    columns aren't read. A text is whole in a chunk, with some 60 bytes of memory
    for each of its own; texts are told by 128 bits of their SHA-256.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.encode(text, "UTF-8"), 256)
    own = Kept(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(sha).alias("sha")).select("doc_id", "n_bytes", F.substring("sha", 1, 16).alias("name"), "sha"))
    texts = docs.select(text.alias("text"))
    total = own.df.agg(F.sum("n_bytes")).first()[0] or 0
    samples, chunk_bytes = int(total * len(COVER) / PERIOD), sized(4 * int(total), *CHUNK_BYTES)
    buckets = max(1, -(-samples // sized(samples, *BUCKET_KEYS)))

    sampled = texts.mapInArrow(_send_samples(buckets, chunk_bytes), _SENT).groupBy("bucket").applyInArrow(_judge_samples, "chunk binary, pos binary, names binary, off binary")
    found = Kept(sampled.groupBy("chunk").applyInArrow(_by_text, "name binary, samples binary").dropDuplicates(["name"]))
    release(spark)

    bits = spark.sparkContext.broadcast(_filter(found.df.select("name")))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = bits.value
        for part, t in B.slices(batches, "text", CHUNK_BYTES[0]):
            name = _names(t)
            first, _ = codes(name)
            go = np.ones(len(first), bool)
            for k in range(2):
                p = name[first, k] & np.uint64(FILTER_WORDS * 64 - 1)
                go &= (ok[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            if go.any():
                yield pa.RecordBatch.from_arrays([binary(name[first[go]]), part.column(0).take(pa.array(first[go]))], ["name", "text"])

    joined = texts.mapInArrow(held, "name binary, text string").join(found.df, "name").dropDuplicates(["name"])
    chunks = Kept(joined.select("name", "text", "samples").mapInArrow(lambda batches: _pack(batches, chunk_bytes), _CHUNK))
    found.drop()
    release(spark)

    windows = chunks.df.agg(F.sum("windows")).first()[0] or 0
    per_round = max(1, -(-int(windows) // (ROUNDS * sized(windows, *BUCKET_KEYS))))
    hits = []
    for r in range(ROUNDS):
        ranked = chunks.df.mapInArrow(_send_ranks(r, per_round), _RANKS).groupBy("bucket").applyInArrow(_judge_ranks, "chunk long, bucket long, hit binary")
        hits.append(Kept(ranked))
        release(spark)
    all_ = hits[0].df
    for h in hits[1:]:
        all_ = all_.union(h.df)
    by_chunk = all_.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hit")).alias("hits"))
    result = Kept(chunks.df.join(by_chunk, "chunk", "left").mapInArrow(_spans(per_round), _RESULT))
    for x in (chunks, *hits):
        x.drop()
    release(spark)

    # Written, so that both sides of the join by name are plain exchanges and Spark can split a text's many copies.
    many = own.df.groupBy("name").agg(F.count("*").alias("copies"))
    facts = Kept(many.join(result.df, "name", "left").where("copies > 1 OR n_removed > 0"))
    result.drop()
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return own.df.join(facts.df, "name", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )


def _filter(found: DataFrame) -> np.ndarray:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FILTER_WORDS, np.uint64)
        for b in batches:
            name = names(b.column(0))
            for k in range(2):
                p = name[:, k] & np.uint64(FILTER_WORDS * 64 - 1)
                np.bitwise_or.at(out, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    return summed(found.mapInArrow(fill, "v binary"), FILTER_WORDS, np.bitwise_or).view(np.uint64)
